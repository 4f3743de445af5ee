"""Streaming.

There are no streaming operators here: no watermarks, windows or state.  Row-local functions
(`functions.fx`, `functions.numbers`, `functions.dates` with a known layout, the filters of
`operators.rows` and `operators.derive`) are plain column expressions and work unchanged on a
streaming DataFrame; anything that needs the row index does not.
"""
