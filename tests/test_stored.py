"""Adding to a published index, and inputs that used to lose rows."""

import pytest
from pyspark.sql import functions as F

from conftest import docs_df
from lexspark.operators import incremental as inc
from lexspark.operators import index as ix
from lexspark.operators import ranking as rk
from lexspark.session import scratch_path
from lexspark.sinks import index_json
from lexspark.sinks import index_store as store
from lexspark.sources import files
from lexspark.sources.index_json import legacy_index
from lexspark.sources.markup import xml_to_text

BASE = [("a", "x y z x"), ("b", "y q"), ("c", "")]
MORE = [("b", "new words y"), ("d", "x x new")]


def rows(index):
    return ({tuple(r) for r in index.postings.select("doc_key", "term", "freq", "term_count").collect()},
            {tuple(r) for r in index.doc_freq.select("term", "df").collect()},
            {tuple(r) for r in index.documents.select("doc_key", "term_count").collect()}, index.n_docs)


def full(spark, texts):
    return rows(ix.build_index(docs_df(spark, list(texts.items())), stem=False))


@pytest.mark.parametrize("policy", ["replace", "ignore"])
def test_appending_equals_a_full_build(spark, policy):
    root = scratch_path(spark, "t-append")
    store.publish_index(ix.build_index(docs_df(spark, BASE), stem=False), root, buckets=3)
    first = store.published_versions(spark, root)[0]
    store.append_documents(spark, root, docs_df(spark, MORE), policy)
    store.append_documents(spark, root, docs_df(spark, [("e", "last x"), ("a", "again")]), policy)
    want = dict(BASE)
    for key, text in [*MORE, ("e", "last x"), ("a", "again")]:
        if policy == "replace" or key not in want:
            want[key] = text
    got = store.load_published(spark, root)
    assert rows(got) == full(spark, want)
    assert rows(store.load_index(spark, first)) == full(spark, dict(BASE))  # the old version is untouched
    top = [(r.doc_key, r.rank) for r in rk.search(got, "x new").collect()]
    store.compact(spark, root)
    compacted = store.load_published(spark, root)
    assert compacted.buckets and rows(compacted) == full(spark, want)
    assert [(r.doc_key, r.rank) for r in rk.search(compacted, "x new").collect()] == top


def test_a_stored_index_takes_all_policies(spark):
    root = scratch_path(spark, "t-policies")
    store.publish_index(ix.build_index(docs_df(spark, BASE), stem=False), root, buckets=3)
    base = store.load_published(spark, root)
    with pytest.raises(ValueError, match="already indexed"):
        inc.add_documents(base, docs_df(spark, MORE), "error")
    with pytest.raises(ValueError, match="already indexed"):
        store.append_documents(spark, root, docs_df(spark, MORE))
    added = inc.add_documents(base, docs_df(spark, [("d", "x")]), "error")
    assert rows(added) == full(spark, {**dict(BASE), "d": "x"})
    assert added.doc_terms.count() == 4
    for policy in ("replace", "ignore"):
        want = {**dict(BASE), **dict(MORE)} if policy == "replace" else {**dict(MORE), **dict(BASE)}
        assert rows(inc.add_documents(base, docs_df(spark, MORE), policy)) == full(spark, want)
    with pytest.raises(ValueError, match="both"):
        inc.merge_indexes(base, ix.build_index(docs_df(spark, MORE), stem=False))


def test_empty_documents_survive_the_legacy_form(spark):
    path = scratch_path(spark, "t-legacy-empty")
    index_json.write_legacy_index(ix.build_index(docs_df(spark, BASE), stem=False), path)
    back = legacy_index(spark, path)
    assert rows(back) == full(spark, dict(BASE))
    line = scratch_path(spark, "t-legacy-line")
    spark.createDataFrame([('{"a":{"X":1},"b":{}}',)], "value string").write.text(line)
    assert legacy_index(spark, line).n_docs == 2


def test_every_file_has_a_row(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/sub/.git")
    for name, text in {"c.txt": "x", "_x.txt": "y", ".x.txt": "y", ".gitignore": "z", "d.html": "<p>", "sub/e.txt": "",
                       "sub/.git/config.txt": "q", "README": "r"}.items():
        with open(f"{tmp_dir}/{name}", "w") as f:
            f.write(text)
    got = {r.doc_key.split(tmp_dir)[1]: (r.status, r.error) for r in files.read_folder(spark, tmp_dir).collect()}
    hidden = ("skipped", "hidden file")
    assert got == {"/c.txt": ("ok", None), "/_x.txt": hidden, "/.x.txt": hidden, "/.gitignore": hidden,
                   "/d.html": ("skipped", "unsupported extension html"), "/sub/e.txt": ("ok", None),
                   "/sub/.git/config.txt": hidden, "/README": ("skipped", "no extension")}
    assert files.skip_accounting(files.read_folder(spark, tmp_dir)).agg(F.sum("files")).first()[0] == 8


@pytest.mark.parametrize("encoding", ["foo", "shift_jis", "utf-7"])
def test_unknown_encodings_skip_the_document(encoding):
    text, status, error = xml_to_text(f'<?xml version="1.0" encoding="{encoding}"?><a>x</a>'.encode())
    assert (text, status) == (None, "skipped") and error


def test_a_string_is_text_whatever_it_declares():
    assert xml_to_text('<?xml version="1.0" encoding="iso-8859-1"?><a>\u00e9</a>')[:2] == ("\u00e9 ", "ok")


def test_bucket_count_follows_the_data(spark, monkeypatch):
    index = ix.build_index(docs_df(spark, BASE), stem=False)
    assert store.bucket_count(index) == store.LEAST_BUCKETS
    monkeypatch.setattr(store, "BUCKET_POSTINGS", 1)
    monkeypatch.setattr(store, "LEAST_BUCKETS", 1)
    assert store.bucket_count(index) == index.n_postings == 5


def test_the_zip_holds_the_whole_package(tmp_dir):
    """Imported from the zip alone, in another folder, the package works."""
    import subprocess
    import sys

    from lexspark.session import package_zip
    path = package_zip(tmp_dir)
    code = "import lexspark, lexspark.functions.stem as s; print(lexspark.__file__, s.stem('running'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_dir, env={"PYTHONPATH": path, "PATH": "/usr/bin:/bin"},
                         capture_output=True, text=True, check=True).stdout.split()
    assert out[0].startswith(path) and out[1] == "run"
