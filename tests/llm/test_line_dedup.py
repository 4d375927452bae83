import pytest
from fraudloom.llm.common import LOWER, WHITE
from fraudloom.llm.line_dedup import dedup_lines


def brute(rows, min_chars=20, min_records=3):
    holders = {}
    key = lambda line: line.strip(WHITE).encode().translate(LOWER)
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(line.strip(WHITE)) >= min_chars:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_records or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


ROWS = [(f"e{i:03d}", "\n".join(x for x in (
    "Shared by every reason of this log", f"own line number {i} which is long enough", "  SHARED by every reason OF this log\t" if i % 3 else "",
    "short", "Straße größer als zwanzig Zeichen" if i % 4 == 0 else "twice only in two records" if i in (5, 6) else "", ""))) for i in range(40)]
ODD = [("e100", None), ("e101", ""), ("e102", "\n\n"), (None, "Shared by every reason of this log"), ("e103", "Shared by every reason of this log\r\nx"),
       ("e103", "Shared by every reason of this log\r\nx"), ("e104", "long " * 30_000 + "\nShared by every reason of this log")]


@pytest.mark.parametrize("rows", [ROWS, ROWS + ODD, ODD, []])
@pytest.mark.parametrize("bits", [1 << 19, 1 << 26])
def test_same_as_brute_force(reasons_of, rows, bits):
    got = dedup_lines(reasons_of(rows), filter_bits=bits).collect()
    assert sorted(((r.event_id, r.reason or "", r.n_lines, r.n_dropped) for r in got), key=str) == brute(rows)


def test_extra_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(i, "a line that is in all of the records", 7, "x", "y", 9) for i in range(4)], "event_id long, reason string, n_lines int, k1 string, _keys string, block int")
    got = sorted(dedup_lines(df).collect())
    assert [r.reason for r in got] == ["", "", "", "a line that is in all of the records"]
    assert {(r.n_lines, r.k1, r._keys, r.block) for r in got} == {(1, "x", "y", 9)}


def test_null_text_stays_null_and_bad_size_is_refused(reasons_of):
    assert dedup_lines(reasons_of([("e1", None)])).first().reason is None
    with pytest.raises(ValueError):
        dedup_lines(reasons_of([("e1", "x")]), filter_bits=1000)
