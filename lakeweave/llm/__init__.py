"""Operators for building training corpora at scale.

Nothing outside this subpackage imports it. Each module holds one operator with
its own general interface; :mod:`lakeweave.llm.queries` binds them to tables.
"""
