"""Parameters of the registered queries, shared by the Spark plans and the SQL oracle."""

from __future__ import annotations

from ..operators.ranking import RANK_DECIMALS, TOP_K  # noqa: F401  (re-exported)

# Literal queries (free text, analyzed like documents).
QUERY_TOP20 = "disgusting Einheit lement, the tioned"
QUERY_REPEATS = "the the tioned , lement lement . disgusting"
QUERY_NO_MATCH = "zzzqqq qqqzzz"
QUERY_PAGES = "the weather, der Zeit et le monde"
QUERY_STEMMED = "running shaders, the generated textures"

# Buckets of a stored index in the registered queries (small corpora).
BUCKETS = 8
# Document ids of a range of packed postings (small corpora).
SPAN = 64
# Files a table is split into when it is replayed as a stream.
STREAM_FILES = 4

# Scoped search (S2): only these sources are indexed.
SCOPED_SOURCES = ["src1", "src2", "src3", "src11"]
# Incremental queries: documents of sources ordered at or after this one form the new batch.
DELTA_FROM_SOURCE = "src5"
# Uniqueness check: the documents of this source arrive a second time.
DUPLICATED_SOURCE = "src7"
# Foreign-key check: the documents of this source are missing from the documents table.
ORPHANED_SOURCE = "src2"

