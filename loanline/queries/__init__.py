"""Checked queries: each operator over the test tables, with equivalent SQL where there is one."""

from loanline.queries import cleaning, encoding, metrics, registry, runs, streams, tables, training

FAMILIES = [tables, cleaning, encoding, metrics, runs, registry, training, streams]

QUERIES = {name: query for family in FAMILIES for name, (query, _) in family.QUERIES.items()}
ORACLE = {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
