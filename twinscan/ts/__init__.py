"""A TypeScript front end in Python: parser, trees, canonical forms and units of source files."""
