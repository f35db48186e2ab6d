"""DataFrame operators over requests, captures, pages and outcomes."""
