"""Training-data operators: WARC derivatives, chat formatting, deduplication, mixing, scoring, tokens, HTML and media."""
