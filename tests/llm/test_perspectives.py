import duckdb
import pandas as pd

from spanforge.llm import perspectives


def brute(turns, size):
    convs = {}
    for conv, turn, role, text in turns:
        convs.setdefault(conv, []).append((turn, role, text))
    out = []
    key = lambda t: [(x is not None, x if x is not None else 0 if i == 0 else "") for i, x in enumerate(t)]
    for conv, rows in convs.items():
        rows.sort(key=key)
        for who in {r for _, r, _ in rows if r is not None and r != "system"}:
            for p in range(0, len(rows), size):
                s, masks, n = "", [], 0
                for _, role, text in rows[p : p + size]:
                    name = "assistant" if role == who else "system" if role == "system" else f"user:{role or 'unknown'}"
                    s += f"<|{name}|>\n"
                    body = (text or "").replace("<|", "< |") + "<|end|>"
                    if role == who:
                        masks.append(f"{len(s)}:{len(s) + len(body)}")
                        n += len(body)
                    s += body + "\n"
                out.append((conv, who, p // size, len(rows[p : p + size]), s, ",".join(masks), n))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.conv_id, r.perspective, r.part, r.n_turns, r.text, r.masks, r.n_trained) for r in df.collect()), key=str)


ODD = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|> é"), (1, 2, "bob", None), (1, 3, None, "who?"), (1, 3, None, "who?"), (1, None, "ann", ""), (2, 0, "system", "alone"), (None, 0, "eve", "x"), (None, 1, "dan", "\U0001f600")]
ODD += [(3, i, ["ann", "bob", "cat"][i % 3], f"turn {i}") for i in range(300)]


def test_odd_rows_and_sql(spark):
    turns = spark.createDataFrame([(*t, "x") for t in ODD], "conv_id long, turn long, role string, text string, part string").repartition(3)
    assert got(perspectives.rotate(turns, 7)) == brute(ODD, 7)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(ODD, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.sql(perspectives.SQL).fetchall(), key=str) == brute(ODD, 64) == got(perspectives.rotate(turns))
    assert perspectives.rotate(turns.limit(0)).count() == 0


def test_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(perspectives.rotate(turns)) == brute([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()], 64)
