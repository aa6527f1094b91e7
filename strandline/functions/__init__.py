"""Column functions on alignments, sequences, keys and orders; all of them run in the JVM."""
