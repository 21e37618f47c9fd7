"""Scripts as plans: lexer, parser, syntax tree, rewriting and merging."""
