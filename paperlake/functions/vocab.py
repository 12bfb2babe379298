"""Fixed word lists and labels."""

# Words never used as search keywords.
STOP_WORDS = """
a an the and or but in on at to for
of with by from is are was were be been
has have had do does did will would could
should may might can shall not no nor so
as if then than that this these those it
its about above after again all also any
because before between both each few more
most other over same some such through under
up very what when where which while who
how using based via into during upon their
our your we they papers paper recent new
find search get show use
""".split()

# Stems that mark a life-science topic.
LIFE_SCIENCE_STEMS = """
biology biomedical genomic protein gene cancer
clinical drug molecule cell neuro brain disease
pathology immunology virology microbiology ecology
biochem bioinformatics protac crispr rna dna
enzyme receptor antibody vaccine epidemiology
pharmacol metabol transcript sequencing organism
tissue morpholog phenotype genotype mutation
medical health diagnosis therapy treatment
""".split()

# Source labels as they appear in records.
ATOM_SOURCE = "arXiv"
PREPRINT_SOURCES = ("bioRxiv", "medRxiv")
UNKNOWN_SOURCE = "unknown"

# The eight metadata keys of a paper, in order.
META_KEYS = (
    "title",
    "authors",
    "published_date",
    "doi",
    "url",
    "pdf_url",
    "categories",
    "source",
)

# Texts that count as an empty cell.
EMPTY_TEXTS = ("", "null", "None", "none")
