"""All queries of the library by name, with the SQL they are held against."""

from __future__ import annotations

from weft.queries import blocks, graph, signatures, tokens

BOOKS = (tokens.BOOK, blocks.BOOK, graph.BOOK, signatures.BOOK)
QUERIES = {name: query for book in BOOKS for name, query in book.queries.items()}
ORACLES = {name: sql for book in BOOKS for name, sql in book.oracles.items()}
