"""Readers and writers of sequence, record and interchange formats."""
