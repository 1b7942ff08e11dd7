"""Training-data operators: tokenising, packing, near-duplicate joins, quality, archives, scoring.

Nothing outside this subpackage imports it; ``corvid.llm.queries`` lists its queries.
"""
