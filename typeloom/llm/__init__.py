"""Training-data pipeline operators: chat formatting, licence and secret scans, near-duplicate joins,
HTML extraction, WARC archives, decontamination, quality rules, token shards and source mixing.

Nothing else in the library imports this subpackage; `typeloom.llm.queries` binds the operators to the tables.
"""
