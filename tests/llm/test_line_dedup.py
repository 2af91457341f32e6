"""Line dedup against a plain loop."""

from collections import Counter, defaultdict

import pytest

from proofcast.llm.line_dedup import line_dedup

LAST = 2**63 - 1
SHARED = "A line that many share"
ROWS = [
    (5, f"{SHARED}\nown line of five\n{SHARED}"), (2, f"own line of two\n \t{SHARED.upper()} \n"), (3, f"{SHARED}\nshort\nshort"), (4, "short\nshort"),
    (6, None), (7, ""), (8, "\n\n"), (None, f"{SHARED}\nlast of all"), (9, "ÄÖ eine zeile mehr\nx"), (10, "äö eine zeile mehr\nÄÖ eine zeile mehr"),
    (11, "same row, same id"), (11, "same row, same id"), (12, " " + SHARED), (13, "\n".join(f"line number {i} of many" for i in range(3000))),
    (14, "line number 7 of many\rx\nline number 7 of many"),
]


def brute(rows, least=10, threshold=2):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: LAST if i is None else i
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= threshold and order(i) != min(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("threshold", [2, 4])
def test_same_as_loop(docs_of, threshold):
    got = line_dedup(docs_of(ROWS), threshold=threshold).select("row.doc_id", "n_lines", "n_dropped", "kept")
    assert Counter(map(tuple, got.collect())) == brute(ROWS, threshold=threshold)


def test_other_columns_stay_and_empty_table(docs_of):
    got = line_dedup(docs_of(ROWS))
    assert [f.name for f in got.schema["row"].dataType] == ["doc_id", "name", "key", "kept", "pos", "id", "fp"]
    assert line_dedup(docs_of([])).count() == 0
