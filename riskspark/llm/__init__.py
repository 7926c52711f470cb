"""Training-data operators: deduplication, classification, extraction,
mixing, fingerprints and tokenisation over tables of documents, vectors and
pages.  Nothing else in the library imports this subpackage."""
