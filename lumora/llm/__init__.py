"""Training-data operators: ten operators over large text collections and their queries.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries
when it can be imported.
"""
