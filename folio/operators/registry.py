"""All queries of the document operators by name, and their SQL."""

from folio.operators import cascade, documents, editing, extracts, feeds, files, html, pages, papers, prompts, records, search, searches, stores, structure, structures

PARTS = (documents, records, structure, editing, extracts, feeds, files, html, pages, papers, search, searches, stores, structures, prompts, cascade)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
