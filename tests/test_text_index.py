"""Phrases by word positions, and an index that is kept up in segments."""

import random

import pytest

from reelflow.operators import changes, search, text_index as T
from reelflow.streaming import reactions
from tests.conftest import make

WORDS = "alpha beta gamma delta alphabet".split()
CHANGES = "op string, old_film_id long, old_title string, old_description string, new_film_id long, new_title string, new_description string"


def texts(seed, n=60):
    r = random.Random(seed)
    return {k: (" ".join(r.choices(WORDS, k=r.randint(0, 3))), r.choice([None, ", ".join(r.choices(WORDS, k=r.randint(0, 9)))])) for k in range(n)}


def films(spark, given):
    return make(spark, "film_text", *[{"film_id": k, "title": t, "description": d} for k, (t, d) in given.items()])


@pytest.mark.parametrize("phrase", ["alpha", "Alpha  beta", "alpha alpha", "alpha alpha alpha", "beta-gamma", "alpha nothing", "", "gamma delta alpha beta"])
def test_phrase_equals_a_scan(spark, phrase):
    given = texts(1)
    words = T.phrase_words(phrase)
    want = {}
    for k, (title, text) in given.items():
        own = T.phrase_words(f"{title} {text or ''}")
        at = [i + 1 for i in range(len(own)) if words and own[i : i + len(words)] == words]
        if at:
            want[k] = (len(at), at[0])
    found = T.find_phrase(T.positional_postings(films(spark, given)), phrase)
    assert {r.film_id: (r.n_hits, r.first_position) for r in found.collect()} == want


def rounded(df):
    return sorted((r.film_id, round(r.score, 9)) for r in df.collect())


def test_segments_equal_a_rebuild(spark, tmp_path):
    r, path = random.Random(4), str(tmp_path / "index")
    now = texts(2)
    T.create_index(films(spark, now), path, min_len=1)
    files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("*.parquet")}
    for segment in (1, 2, 3):
        rows, after = [], dict(now)
        for k in r.sample(sorted(now), 12):
            title, text = now[k]
            kind = r.choice(["delete", "update", "rename"])
            if kind == "delete":
                rows.append(("delete", k, title, text, None, None, None))
                del after[k]
                continue
            new = k + 1000 * segment if kind == "rename" else k
            fresh = (" ".join(r.choices(WORDS, k=2)), text)
            rows.append(("update", k, title, text, new, *fresh))
            if fresh != (title, text):
                del after[k]
                after[new] = fresh
        rows += [("insert", None, None, None, 500 + segment, "alpha beta", "gamma")]
        after[500 + segment] = ("alpha beta", "gamma")
        batch = spark.createDataFrame(rows, CHANGES)
        for _ in range(2):  # a replayed batch changes nothing
            T.apply_changes(batch, path, segment, min_len=1)
        assert changes.sync_film_text(films(spark, now), batch).count() == len(after)
        now = after
        for query in ("alpha", "gamma delta", "alphabet alpha alpha beta", "nothing"):
            want = search.score_documents(films(spark, now), T.COLUMNS, query, min_len=1, max_doc_share=0.9)
            assert rounded(T.search_index(spark, path, query, min_len=1, max_doc_share=0.9)) == rounded(want)
    assert all((tmp_path / "index").joinpath(f).stat().st_mtime_ns == m for f, m in files.items())
    merged = str(tmp_path / "merged")
    T.merge_segments(spark, path, merged)
    assert rounded(T.search_index(spark, merged, "alpha delta", min_len=1, max_doc_share=0.9)) == rounded(T.search_index(spark, path, "alpha delta", min_len=1, max_doc_share=0.9))


def test_stream_of_changes_keeps_the_index(spark, tmp_path):
    path, arrivals = str(tmp_path / "index"), tmp_path / "in"
    arrivals.mkdir()
    now = films(spark, {1: ("alpha", None), 2: ("beta beta", "gamma")})
    T.create_index(now, path, min_len=1)
    stream = spark.readStream.schema(CHANGES).parquet(str(arrivals))
    for row in (("insert", None, None, None, 3, "gamma delta", None), ("delete", 1, "alpha", None, None, None, None), ("update", 2, "beta beta", "gamma", 9, "beta", "gamma")):
        batch = spark.createDataFrame([row], CHANGES)
        batch.write.mode("append").parquet(str(arrivals))
        reactions.start(stream, reactions.keep_text_index(path, min_len=1), str(tmp_path / "cp")).awaitTermination(120)
        now = changes.sync_film_text(now, batch)
        for query in ("gamma", "alpha", "beta delta"):
            want = search.score_documents(now, T.COLUMNS, query, min_len=1, max_doc_share=1.0)
            assert rounded(T.search_index(spark, path, query, min_len=1, max_doc_share=1.0)) == rounded(want)
    assert sorted(r.film_id for r in now.collect()) == [3, 9]


def test_search_reads_the_words_buckets_only(spark, tmp_path):
    path = str(tmp_path / "index")
    T.create_index(films(spark, texts(3)), path, min_len=1)
    text = T.search_index(spark, path, "alpha", min_len=1)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan" in line and "term" in line.split("ReadSchema")[-1]]
    assert scans and all("bucket" in line.split("PartitionFilters:")[1].split("PushedFilters")[0] for line in scans)
