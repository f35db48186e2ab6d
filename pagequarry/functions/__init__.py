"""Column functions: text, URLs, headers, response rules and message texts."""
