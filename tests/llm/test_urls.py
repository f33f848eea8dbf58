"""Rules against a plain reading, segmentation against all splits, verdicts on held-out names."""

import itertools
import math

from pyspark.sql import functions as F

from reelflow.llm import urls as U


def test_rules():
    by_host = {}
    for h, p, v in U.RULES:
        by_host.setdefault(h, []).append((p, v))
    rule = lambda h, p: U.matching_rule(h, p, by_host)
    assert rule("a.net", "/x") == ("net/", "block") and rule("net", "/") == ("net/", "block")
    assert rule("www.example.net", "/en/1") == ("example.net/en/", "allow") and rule("example.net", "/en") == ("net/", "block")
    assert rule("a.net", "") == (None, None) and rule("xnet", "/") == (None, None) and rule("notexample.com", "/de/") == (None, None)
    assert rule("x.org", "/fr/1") == ("org/fr/", "allow") and rule("", "") == (None, None)


def test_best_split_of_all():
    words = U.Words({"casino": -5.0, "win": -6.0, "cas": -6.5, "in": -4.0, "ow": -9.0, "a": -3.0}, math.log(10 / 1000))

    def cost(parts):
        return sum(words.log.get(p, words.unknown - len(p) * math.log(10)) for p in parts)

    for text in ("casinowin", "winacasin", "xwin", "a", ""):
        best = -math.inf
        for cuts in itertools.product((0, 1), repeat=max(0, len(text) - 1)):
            parts, at = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[at:k])
                    at = k
            best = max(best, cost([p for p in [*parts, text[at:]] if p]))
        got = words.split(text)
        assert "".join(got) == text and abs(cost(got) - best) < 1e-9
    assert words.split("casinowin") == ["casino", "win"]


def test_cases(pages):
    rows = [(k, f"http://good{w}.test/{w}/story", f"<p>{w} casino pills win cheap story news</p>") for k, w in enumerate(["apple", "river", "stone", "cloud"] * 5)]
    rows += [(100 + k, f"https://{h}.test/win/now", "<p>win</p>") for k, h in enumerate(["casinowin", "cheap-pills", "winpills", "casino-cheap"] * 4)]
    rows += [(200, "http://cheapwin.test/win", None), (201, "HTTP://User.GOOD.Net/a?b#c", ""), (202, None, "x"), (203, "no scheme", "x"), (204, "x://", "x"),
             (None, "http://a.org/fr/x", "x"), (206, "http://É.net#/x", "x"), (207, "http://" + "a" * 50_000 + ".test/", "x"), (200, "http://cheapwin.test/win", None)]
    out = U.verdicts(pages(*rows).withColumn("host", F.lit("clash")).withColumn("v", F.lit(1))).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[100].words == "casino win test" and all(by[100 + k].verdict == "block" for k in range(16))
    assert all(by[k].verdict == "allow" for k in range(20))
    assert by[200].verdict == "block", "no seed word, but words of blocked hosts"
    assert (by[201].host, by[201].path, by[201].rule, by[201].verdict) == ("user.good.net", "/a", "net/", "block")
    for k in (202, 203, 204):
        assert (by[k].host, by[k].path, by[k].rule, by[k].verdict) == ("", "", None, "allow")
    assert (by[None].rule, by[None].verdict) == ("org/fr/", "allow") and (by[206].host, by[206].path, by[206].rule) == ("É.net", "", None)
    assert U.verdicts(pages()).collect() == []


def test_rare_words_behind_50000(pages):
    """A word that 60,000 others outnumber still splits hosts."""
    filler = ["".join(w) for w in itertools.islice(itertools.product("cdfghjkmnpsv", repeat=5), 60_000)]
    rows = [(k, f"http://plain{k}.test/", "<p>" + " ".join(filler[k::4] * 2) + "</p>") for k in range(4)]
    rows += [(10, "http://zebraquilt.test/", "<p>zebra quilt</p>")]
    out = {r.page_id: r for r in U.verdicts(pages(*rows)).collect()}
    assert out[10].words == "zebra quilt test"


def test_pieces_of_a_long_run_come_in_small_batches():
    import random

    import pyarrow as pa

    r = random.Random(1)
    run = "".join(r.choices("abcdefghij", k=30_000))
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([run])], ["k", "run"])
    sizes, found = [], set()
    for b in U._pieces(iter([batch])):
        sizes.append(b.num_rows)
        found.update(b.column(1).to_pylist())
    assert max(sizes) <= U.RANGE * U.WORD_CHARS and len(sizes) == -(-len(run) // U.RANGE)
    assert found == {run[a : a + n] for a in range(len(run)) for n in range(1, U.WORD_CHARS + 1)}


def test_long_path_of_known_words(pages, prose):
    """A path of a hundred thousand letters is split at the words of the pages' texts."""
    vocabulary = sorted(set(prose(5, 40).split()))
    path = "".join(vocabulary[k % len(vocabulary)] for k in range(20_000))
    rows = [(1, f"http://h.test/{path}", "<p>" + " ".join(vocabulary * 50) + "</p>")]
    out = U.verdicts(pages(*rows)).collect()
    assert len(path) > 90_000 and out[0].path == "/" + path and out[0].words == "h test"
    assert U.verdicts(pages(*rows, (2, None, None))).count() == 2
