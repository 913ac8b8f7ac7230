"""Training-data pipeline operators.

Nothing outside this subpackage imports it; its queries are listed in
``brindle.llm.queries``.
"""
