"""Readers and writers of pedigree, variant, interval, alignment and sequence files."""
