"""Readers: directory listings, text lines, LAS and deviation files, trace headers, SEG-Y volumes, DLIS frames."""
