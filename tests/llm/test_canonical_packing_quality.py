import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import canonical, packing, quality, tokens

COUNTRIES = [("Rolttel", "RO"), ("Tondhe, Republic of", "TO"), ("Saint Drodath", "SD"), ("North Peteklult", "NT"), ("South Peteklult", "SH"), ("Zaltbelt, Federated States of", "ZL"), ("Puverk and Pemgo", "PV")]
MATCHER = canonical.Matcher([*COUNTRIES, ("Wolstinhistan", "RO")], {c.lower(): c for _, c in COUNTRIES})


@pytest.mark.parametrize("value,want", [
    ("rolttel.", "RO"), ("ROTLEL", "RO"), ("The Rolttel", "RO"), ("Rôlttel", "RO"), ("(Rolttel)", "RO"), ("Rolttel [RO]", "RO"), ("ro", "RO"), ("Klav, Rolttel", "RO"), ("WOLSTINHISTAN", "RO"),
    ("Republic of Tondhe", "TO"), ("Rep. of Tondhe", "TO"), ("Tondhe", "TO"), ("Republic\xa0of\xa0Tondhe", "TO"), ("TONDHHE, EPUBLIC OF", "TO"), ("Republic_of_Tondhe", "TO"),
    ("St. Drodath", "SD"), ("Snt. Drodath", "SD"), ("Peteklult, North", "NT"), ("S. Peteklult", "SH"), ("Northern Peteklult", "NT"), ("FS Zaltbelt", "ZL"), ("Fed. States of Zaltbelt", "ZL"), ("Puverk/Pemgo", "PV"), ("Puverk & Pemgo", "PV"), ("Roltel", "RO"), ("Saint rDdath", "SD"),
    ("Breilrerkstead", ""), ("TBD", ""), ("xx", ""), ("", ""), ("?", ""), ("Peteklult", ""), ("Kazotrai Valley", ""), ("z" * 5000, ""),
])
def test_country_cases(value, want):
    assert MATCHER.match([value]) == [want]


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_slips():
    r = random.Random(0)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 8)))
    pairs = [(word(), word()) for _ in range(400)]
    assert canonical.slips([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [osa(a, b) for a, b in pairs]


def test_map_values(spark):
    rows = spark.createDataFrame([("rolttel", 1), ("rolttel", 2), ("nothing", 3)], "value string, canonical int")
    assert {r["value"]: r["canonical"] for r in canonical.map_values(rows, MATCHER).collect()} == {"rolttel": "RO", "nothing": ""}
    assert canonical.map_values(rows.limit(0), MATCHER).count() == 0
    assert canonical.Matcher([]).match(["abcdef"]) == [""]


@pytest.mark.parametrize("planner", [packing.filled_buckets, packing.best_fit, packing.length_buckets])
def test_packing(spark, planner, monkeypatch):
    monkeypatch.setattr(packing, "PER_TASK", 40)
    r = random.Random(5)
    rows = [(i, 7 if r.random() < 0.3 else r.choice([0, 1, 30, 60, 100, 101, 350, r.randrange(1, 260)])) for i in range(1500)] + [(5000, None)]
    sizes = spark.createDataFrame(rows, "doc bigint, n bigint").repartition(5)
    got = packing.pack(sizes, "doc", "n", 100, planner).collect()
    used, parts = {}, {}
    for x in got:
        used[x["container"]] = used.get(x["container"], 0) + x["length"]
        parts.setdefault(x["doc"], []).append((x["piece"], x["length"]))
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    for doc, n in rows:
        if n:
            assert sum(x for _, x in parts[doc]) == n and [p for p, _ in sorted(parts[doc])] == list(range(-(-n // 100)))
        else:
            assert doc not in parts
    if planner is not packing.length_buckets:
        assert sum(used.values()) / (100 * len(used)) > (0.97 if planner is packing.best_fit else 0.93)
    assert packing.pack(sizes.limit(0), "doc", "n", 100, planner).count() == 0


def test_bucket_plan_is_optimal():
    r = random.Random(1)
    for _ in range(30):
        lengths = sorted(r.sample(range(1, 21), 6))
        h = {x: r.randrange(1, 30) for x in lengths}
        best = min(sum(-(-sum(h[x] for x in lengths[a:b]) // (20 // lengths[b - 1])) for a, b in zip([0, *cuts], [*cuts, 6])) for m in range(32) for cuts in [[i + 1 for i in range(5) if m >> i & 1]])
        assert packing.length_buckets(h, 20)[1] == best


def test_boundaries_leave_least_padding():
    r = random.Random(2)
    for _ in range(30):
        lengths = sorted(r.sample(range(1, 21), 6))
        h = {x: r.randrange(1, 30) for x in lengths}
        cost = lambda bounds: sum((next(b for b in bounds if b >= x) - x) * n for x, n in h.items()) + 10 * len(bounds)  # noqa: E731, B023
        every = [[x for i, x in enumerate(lengths[:-1]) if m >> i & 1] + lengths[-1:] for m in range(32)]
        assert cost(packing.boundaries(h, 10)) == min(map(cost, every))
    many = {x: 5000 for x in range(1, 101)}
    assert packing.boundaries(many, 50) == list(range(1, 101)) and len(packing.boundaries({x: 1 for x in range(1, 101)}, 50)) < 20


def test_threshold_and_lead_decide(monkeypatch):
    two = canonical.Matcher([("north quay", "N"), ("south quay", "S"), ("old brick granary", "G")])
    exact = []
    monkeypatch.setattr(canonical.Matcher, "_exact", lambda self, asked, of, form, cosine, result: exact.extend(asked[k][1] for k in set(of.tolist())))
    assert two.match(["old brik granary", "sorth quay"]) == ["G", ""] and exact == ["sorth quay"]  # the cosine is enough for the first only
    monkeypatch.setattr(canonical, "ACCEPT", 0.99)
    assert two.match(["old brik granary"]) == [""]


def test_many_entries_in_blocks(monkeypatch):
    r = random.Random(8)
    names = sorted({"".join(r.choice("abcdefghiklmnoprst") for _ in range(r.randrange(7, 12))) for _ in range(3000)})
    m = canonical.Matcher([(n, n) for n in names])
    asked = [n[:3] + n[4:] for n in r.sample(names, 60)]
    whole = m.match(asked)
    monkeypatch.setattr(canonical, "HITS", 5000)
    assert m.match(asked) == whole and sum(map(bool, whole)) > 50


def test_tokens(spark):
    texts = ["", None, "two words", "two words", "é" * 40_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n_tokens bigint, text string").withColumnRenamed("n_tokens", "k")
    got = {r["k"]: r["n_tokens"] for r in tokens.token_counts(df, "text", ["k"]).collect()}
    assert (got[0], got[1], got[2], got[3]) == (0, 0, 2, 2) and got[4] > 1000 and got[5] > 1
    assert tokens.token_counts(df.limit(0), "text", ["k"]).count() == 0


def corpus(r):
    """(kind, lang, text): prose in two languages set in several ways, lists, tables and junk."""
    who, what = ["keeper", "mason", "town clerk", "old driver", "woman at the desk", "ferry crew"], ["tower", "gate", "bridge", "sundial", "garden of the inn", "key to the chapel"]
    more = ["because the river was high", "and it was never found again", "but nobody knows why", "when the snow was on the road", "so that the children could see it", "before there was a railway"]
    en = lambda: f"The {r.choice(who)} {r.choice(['wrote about', 'had to leave', 'looked after', 'was proud of'])} the {r.choice(what)} {r.choice(more)}."
    wer, was = ["Wärter", "Maurer", "Fährmann", "Schreiber"], ["Turm", "Garten", "Weg", "Brunnen"]
    de = lambda: f"Der {r.choice(wer)} hat den {r.choice(was)} {r.choice(['nicht gesehen', 'immer gepflegt', 'lange gesucht'])}, {r.choice(['weil es im Winter kalt war', 'und man weiß nicht, warum', 'als der Weg noch offen war'])}."
    kinds, things = "red timber stone ruined twin steep pale narrow painted brick coastal quiet ornate famous disused modest".split(), "gate mill bridge quay granary citadel bastion windpump orangery pagoda aqueduct barrow rampart workshop cenotaph lighthouse".split()
    thing = lambda: f"{r.choice(kinds)} {r.choice(things)}"
    name = lambda: "".join(r.choice(["kar", "lo", "ven", "tri", "mos"]) for _ in range(3)).title()
    wrap = lambda t: "\n".join(" ".join(t.split()[i : i + 8]) for i in range(0, len(t.split()), 8))
    setting = [str, str, str, wrap, str.upper, str.lower, lambda t: t.replace(". ", ".\n- ")]
    out = []
    for i in range(700):
        one = en if i % 4 else de
        out.append(("prose", r.choice(["en", "EN ", None, "de"]) if i % 40 == 0 else "en" if i % 4 else "de", r.choice(setting)(" ".join(one() for _ in range(r.randrange(3, 9))))))
    for _ in range(30):
        n = r.randrange(8, 20)
        out += [("list", "en", r.choice(["\n", "; ", ", "]).join(thing() for _ in range(n))), ("list", None, "\n".join(f"{k + 1}. {thing()}" for k in range(n)))]
        row = lambda c: c.join([name(), str(r.randrange(1400, 2000)), f"{r.random() * 90:.1f}"])
        out += [("table", "en", "\n".join(row(r.choice([",", ";", "\t", " | "])) for _ in range(n))), ("table", "en", "\n".join(f"{k}: {r.randrange(1000)}" for k in ["Built", "Height", "Rooms", "Visits", "Owners", "Number"]))]
        out += [("junk", "en", "".join(r.choice("=#_!//@+^@= /^!*._>&%") for _ in range(200))), ("junk", None, " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randrange(2, 9))) for _ in range(40)))]
        out += [("junk", "en", " ".join(f"0x{r.randrange(2**32):08x} ERR{r.randrange(99)}" for _ in range(n))), ("junk", "en", " ".join(r.sample(" ".join(en() for _ in range(8)).replace(".", "").lower().split(), 60)))]
    return out


def test_distances(spark):
    r = random.Random(7)
    made = corpus(r)
    rows = [(i, text, lang) for i, (_, lang, text) in enumerate(made)] + [(5000, None, "en"), (5001, "  \n", None), (5002, "a,b " * 20_000, "en"), (5003, "", "en")]
    df = spark.createDataFrame(rows, "doc bigint, text string, form string").withColumnRenamed("form", "lang").repartition(3)
    d = quality.prose_distances(df, "doc", "text", "lang").cache()
    found = {x["doc"]: x["kind"] for x in quality.not_prose(d, "doc").collect()}
    assert not {5000, 5001, 5003} & set(found) and found[5002] in ("list", "table", "junk")
    wrong = [(kind, found.get(i, "prose"), text) for i, (kind, _, text) in enumerate(made) if found.get(i, "prose") != kind]
    assert len(wrong) <= 0.02 * len(made), wrong
    got = d.select("distance", "kind", sum(F.col(f"part_{s}") for s in quality.STATS).alias("sum"), "language").collect()
    assert len(got) == len(made) + 1 and all(abs(x["distance"] - x["sum"]) <= 1e-6 * max(1, abs(x["sum"])) and (x["kind"] is not None) == (x["distance"] > quality.CUT) for x in got)
    assert {x["language"] for x in got} == {"en", "de"}
    again = {x["doc"]: x["kind"] for x in quality.not_prose(quality.prose_distances(df.repartition(1), "doc", "text", "lang"), "doc").collect()}
    assert again == found
    assert quality.not_prose(quality.prose_distances(df.limit(0), "doc", "text", "lang"), "doc").count() == 0
    assert quality.prose_distances(df.where("doc in (1, 5000)"), "doc", "text", "lang").count() == 1


def test_estimates_settle_and_words_are_learnt(spark):
    df = spark.createDataFrame([(i, text, lang) for i, (_, lang, text) in enumerate(corpus(random.Random(1)))], "doc bigint, text string, lang string")
    learnt = quality.learn(df, "text", "lang")
    common = {x: {w for w, k in learnt.number.items() if learnt.code[k, i]} for i, x in enumerate(learnt.languages)}
    assert {"the", "was", "it"} <= common["en"] and {"der", "den", "hat"} <= common["de"] and not {"hat", "nicht"} & common["en"]
    prose = quality.fit_prose(quality.text_statistics(df, "doc", "text", "lang", learnt).cache())
    assert prose.rounds < quality.MAX_ROUNDS and all(np.linalg.eigvalsh(c).min() > 0 for c in prose.covariance.values())


def test_texts_are_cut_as_plain_python_cuts_them():
    texts = ["One two,\r\nthree\n\n four!", "d'une  é\tb", "", "a"]
    t = quality.Texts(pa.array(texts, pa.large_string()))
    assert [t.tokens[k].as_py() for k in t.token] == [x for text in texts for x in text.split()]
    assert [t.words[k].as_py() for k in t.word] == ["one", "two", "three", "four", "d", "une", "é", "b", "a"]
    assert t.word_text.tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 3] and t.line_text.tolist() == [0, 0, 0, 1, 3] and t.token_line.tolist() == [0, 0, 1, 2, 3, 3, 3, 4]
