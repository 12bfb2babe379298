"""Compositions of the operators into whole searches and whole harvests."""
