"""Readers of alignments, references, annotations, catalogs and results, and the writers of results."""
