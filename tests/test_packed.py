"""The vectorised splitter against a plain state machine, and its cases."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.operators.packed import explode_packed, inner_marks, split_packed

BLANKS = "   　\x0b\x0c"
SEPS = ",;|\t\n\r；，、·｜"


def plain(text, pairs=()):
    """Character by character; pairs: (word, mark, word) whose mark isn't a separator."""
    if text is None:
        return []
    t = text.strip(BLANKS + "\t\n\r")
    inner = t[1:-1] if len(t) >= 2 and (t[0], t[-1]) in (("[", "]"), ("{", "}")) else text

    def alpha(c):
        return c.isascii() and c.isalpha() or not c.isascii()

    def is_sep(s, i):
        c = s[i]
        if c == "/":
            return not (0 < i < len(s) - 1 and alpha(s[i - 1]) and alpha(s[i + 1]))
        if c not in SEPS:
            return False
        for a, m, b in pairs:
            k = i - len(a)
            if c == m and k >= 0 and s[k:i].lower() == a and s[i + 1 : i + 1 + len(b)].lower() == b:
                if not (k and alpha(s[k - 1])) and not (i + 1 + len(b) < len(s) and alpha(s[i + 1 + len(b)])):
                    return False
        return True

    def next_solid(s, i):
        while i < len(s) and s[i] in BLANKS:
            i += 1
        return i

    out, i, start, fresh = [], 0, 0, True
    s = inner
    values = []
    while i < len(s):
        c = s[i]
        if c in "\"'" and fresh and not (i and s[i - 1] == "\\"):
            j = i
            while j < len(s) and s[j] == c:
                j += 1
            end = None
            lead = j - i
            at_end = lambda k: next_solid(s, k) >= len(s) or is_sep(s, next_solid(s, k))
            if lead % 2 == 0:
                end = j - 1 if at_end(j) else None
            if end is None and not (lead % 2 == 0 and at_end(j)):
                k = j
                while k < len(s):
                    if s[k] == c and s[k - 1] != "\\":
                        r = k
                        while r < len(s) and s[r] == c:
                            r += 1
                        if (r - k) % 2 == 1 and at_end(r):
                            end = r - 1
                            break
                        k = r
                    else:
                        k += 1
            if end is not None:
                values.append(("q", c, s[i + 1 : end]))
                i = end + 1
                while i < len(s) and not is_sep(s, i):
                    i += 1
                i += 1
                start, fresh = i, True
                continue
        if is_sep(s, i):
            values.append(("p", None, s[start:i]))
            start, fresh = i + 1, True
        elif c not in BLANKS:
            fresh = False
        i += 1
    values.append(("p", None, s[start:]))
    for kind, q, v in values:
        if kind == "q":
            v = v.replace("\\" + '"', "\0d").replace("\\'", "\0s").replace(q + q, q).replace("\0d", '"').replace("\0s", "'")
            v = v.strip(BLANKS + "\t\n\r")
        else:
            v = v.strip(BLANKS)
        if v:
            out.append(v)
    return out


def run(rows, marks=()):
    parent, pos, values = split_packed(pa.array(rows, pa.string()), marks)
    out = [[] for _ in rows]
    for p, k, v in zip(parent, pos, values.to_pylist()):
        out[p].append(v)
        assert k == len(out[p])
    return out


def test_cases():
    marks = inner_marks(["quay|wharf front", "mill/forge", 'dock, "wet" type'])
    cases = {
        'a; """blind"" arcade"': ["a", '"blind" arcade'],
        "['x y', \"miners' lodge\"]": ["x y", "miners' lodge"],
        '["a", "\\"b\\" c"]': ["a", '"b" c'],
        "mill/forge / x": ["mill/forge", "x"],
        "1/2": ["1", "2"],
        "a,quay|wharf front|b": ["a", "quay|wharf front", "b"],
        '"blind" arcade': ['"blind" arcade'],
        '"open, x': ['"open', "x"],
        '{"dock, ""wet"" type",b}': ['dock, "wet" type', "b"],
        " , ;; ": [],
        '" "," b "': ["b"],
        "a·b\xa0 ， c\r\nd": ["a", "b", "c", "d"],
        "[]": [],
        "x,x": ["x", "x"],
        None: [],
        "": [],
    }
    assert run(list(cases), marks) == list(cases.values())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \"',;|/\n[]{}·é ", max_size=14)), max_size=8))
def test_against_state_machine(rows):
    got = run(rows)
    for row, values in zip(rows, got):
        if row is not None and row.count('"') + row.count("'") <= 1:  # quotes that don't pair are ordinary in both
            assert values == plain(row), row


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab ,;\"é", min_size=1, max_size=6).map(str.strip).filter(bool), min_size=1, max_size=6), st.sampled_from([",", "; ", " | ", "\t", "；"]))
def test_quoted_round_trip(values, sep):
    packed = sep.join('"' + v.replace('"', '""') + '"' for v in values)
    assert run([packed])[0] == values


def test_slices_and_long_rows():
    whole = pa.array(["a,b", None, "c", "d;e" * 1])
    parent, pos, values = split_packed(whole.slice(1, 3))
    assert parent.tolist() == [1, 2, 2] and values.to_pylist() == ["c", "d", "e"]
    long = ",".join(['"x, y"', "z"] * 5000)
    assert run([long])[0] == ["x, y", "z"] * 5000


def test_operator(spark):
    df = spark.createDataFrame([(1, "a,b", None, "q"), (2, None, "c", "q"), (3, "", "d;e", "q")], "k bigint, f string, g string, value string")
    got = sorted(map(tuple, explode_packed(df, "k", ["f", "g"]).collect()))
    assert got == [(1, "f", 1, "a"), (1, "f", 2, "b"), (2, "g", 1, "c"), (3, "g", 1, "d"), (3, "g", 2, "e")]
    assert explode_packed(df, "k", ["f", "g"], least=2).count() == 4
    assert explode_packed(df.limit(0), "k", ["f"]).count() == 0
