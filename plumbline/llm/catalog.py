"""Importing this module registers every query of this subpackage."""

from plumbline.llm import clusters, conversations, decontamination, languages, lines, minhash, sentencepieces, suffixes, token_counts, topk, toxicity, url_filters, warc  # noqa: F401
