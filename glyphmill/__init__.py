"""glyphmill: text tokenisation as Spark DataFrame plans.

Subpackages
-----------
``sources``    vocabulary files, corpus tables
``functions``  Unicode tables and column expressions
``operators``  basic tokenisation, WordPiece, encoding, vocabulary lookups
``streaming``  the same encoders on streaming DataFrames
``plans``      registered queries and their DuckDB counterparts
``llm``        training-data operators; nothing else imports it
"""
