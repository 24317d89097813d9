"""Registered queries with their SQL twins."""

from tradewinds.plans import eda, extras, forecasts, graphs, inputs, learned, more, studies

QUERIES, ORACLE = {}, {}
for _part in (inputs, eda, forecasts, graphs, studies, extras, more, learned):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
