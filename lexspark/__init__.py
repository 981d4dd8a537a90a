"""lexspark: TF-IDF document search on Spark.

Index documents from a table, a folder or a stream, store the index as Parquet,
and rank documents for one query, a table of queries or a stream of queries::

    from lexspark import build_index, from_table, save_index, load_index, search, search_many

    index = build_index(from_table(spark.read.parquet(path), "doc_id", "text"))
    save_index(index, "/shared/index")
    top = search_many(load_index(spark, "/shared/index"), queries)   # (query_id, rn, doc_key, rank)
"""

from .functions.analyze import token_array
from .functions.stem import stem
from .operators.incremental import add_documents, merge_indexes
from .operators.index import Index, build_index
from .operators.ranking import rank_all, search, search_many
from .sinks.index_json import write_json_index
from .sinks.index_store import append_documents, compact, load_index, load_published, publish_index, save_index
from .sources.files import read_folder
from .sources.index_json import legacy_index, read_json_index
from .sources.markup import html_text, xml_documents
from .sources.tables import from_table

__all__ = [
    "Index", "add_documents", "append_documents", "build_index", "compact", "from_table", "html_text", "legacy_index", "load_index",
    "load_published", "merge_indexes", "publish_index", "rank_all", "read_folder", "read_json_index",
    "save_index", "search", "search_many", "stem", "token_array", "write_json_index", "xml_documents",
]
