"""Values the results depend on: patterns, word lists, messages and catalogs. No logic lives here."""
