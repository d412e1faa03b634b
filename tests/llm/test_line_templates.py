import re
from collections import defaultdict

from storyline.llm import line_templates as T


def brute(rows, min_docs):
    keyed = []
    for key, text in rows:
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.split("[ \t\r]+", line.strip(" \t\r"))]
            if not line.strip(" \t\r") or len(tokens) < T.MIN_TOKENS:
                continue
            tail = tokens[T.LEAD :]
            cut = [len(tail) * i // T.FIELDS for i in range(T.FIELDS + 1)]
            fields = [tuple(tail[a:b]) for a, b in zip(cut, cut[1:])]
            leaf = (len(tokens), *tokens[: T.LEAD])
            keys = [(leaf, i, *(f for j, f in enumerate(fields) if j != i)) for i in range(T.FIELDS)]
            for k in keys if len(tail) >= T.FIELDS else [(leaf, -1, tuple(tokens))]:
                keyed.append((k, text, ((key is not None, key or 0), n)))
    texts, first, dropped = defaultdict(set), {}, set()
    for k, text, place in keyed:
        texts[k].add(text)
        first[k] = min(first.get(k, place), place)
    for k, _, place in keyed:
        if len(texts[k]) >= min_docs and place != first[k]:
            dropped.add(place)
    out = []
    for key, text in rows:
        if text is None:
            out.append((key, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for n, x in enumerate(lines) if ((key is not None, key or 0), n) not in dropped]
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()], key=repr)


def test_templates_against_brute_force(spark):
    rows = []
    for n in range(12):
        lines = [f"own line {'abcdefghijkl'[n] * 3} of this document stands here", f"user u{n} logged in from host h{n} at noon today"]
        lines += ["All rights reserved.", "", "  ", "a b", f"Copyright by {'xyzuvw'[n % 6]} all rights of this page are kept for ever"]
        lines += ["log-in of\tthe  day 7 8 9\r"] * (n % 3)
        rows.append((n, "\n".join(lines)))
    rows += [(100, None), (101, ""), (None, rows[3][1]), (102, "one two three"), (102, "one two three"), (103, "x1 " * 30000)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, key int, line_no string")
    for min_docs in (3, 5, 13):
        got = T.drop_recurring(docs, min_docs)
        assert {"key", "line_no"} <= set(got.columns)
        assert rows_of(got) == brute(rows, min_docs)
    assert T.drop_recurring(docs.limit(0)).count() == 0


def test_copies_of_one_text_do_not_make_a_template(spark):
    docs = spark.createDataFrame([(n, "the same whole text\nstands here many times over") for n in range(9)], "doc_id long, text string")
    assert {r.n_dropped for r in T.drop_recurring(docs).collect()} == {0}
