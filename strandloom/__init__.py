"""Strandloom: curation, splitting and evaluation of biopolymer sequence tables as Spark plans."""
