"""Training-data operators: each module holds one operator and its general interface.

Nothing outside this subpackage imports it.  The queries that bind the operators
to whole tables, and their reference SQL, are in ``brindle.llm.queries``.
"""
