"""Operators for training data: keys seen before, filling of fixed windows, leaked test passages, sentence boundaries."""
