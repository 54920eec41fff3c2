"""Training-data operators: near-duplicate search, extraction, scoring, tokenising.

Nothing outside this folder imports it.  ``llm.queries`` lists its queries.
"""
