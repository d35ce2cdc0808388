"""Op 6: whatever the texts hold, reading gives back the source."""

import hashlib

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from llm_classes import DATA
from pyspark.sql import functions as F

from tessella.llm import chat, sql
from tessella.llm.queries import op6_chat_formatting

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "<\\/s>", "[\\INST]", "ok", "\n", " ", "é", "<\\\\s>", "INST]", "/s>"]
conversation = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x[/INST]", None]), st.none() | st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), min_size=1, max_size=5)


def expected(rows):
    """conv: (n_turns, turns digest, loss chars, loss digest)."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0), r or "", x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(conversation, min_size=1, max_size=25))
def test_round_trip(spark, conversations):
    rows = [(c, t, r, x) for c, turns in enumerate(conversations) for t, (r, x) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.formatted(df)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "b"), (None, 1, None, None), (2, 5, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as loss")
    got = chat.read_back(chat.formatted(df)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(rows)
    assert chat.formatted(df.limit(0)).count() == 0


def test_plain_texts_stay_plain(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b [x] \\"), (1, 1, "assistant", "no"), (2, 0, "user", "</s>")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert out[1].formatted == "<s>[INST]user[/INST]a < b [x] \\</s><s>[INST]assistant[/INST]no</s>"
    assert out[2].formatted == "<s>[INST]user[/INST]<\\/s></s>"
    s = out[1].loss[0]
    assert out[1].formatted[s["start"] : s["end"]] == "no"


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    out = op6_chat_formatting(spark, DATA)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out.collect()} == expected(rows)
    assert "Python" not in out._jdf.queryExecution().toString()


def test_control_strings_never_stand_bare(spark):
    """Lone control strings read back as they are, but would be live ones for a model: they are escaped all the same."""
    rows = [(1, 0, "user", "see [INST] here"), (1, 1, "assistant", "and <s> or [/INST] there"), (1, 2, "</s>", "<s>"), (2, 0, "user", "plain")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r.formatted for r in chat.formatted(df).collect()}
    assert out[1] == r"<s>[INST]user[/INST]see [\INST] here</s><s>[INST]assistant[/INST]and <\s> or [\/INST] there</s><s>[INST]<\/s>[/INST]<\s></s>"
    assert out[2] == "<s>[INST]user[/INST]plain</s>"
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.formatted(df)).collect()} == expected(rows)


def test_bare_control_strings_are_no_turns(spark):
    df = spark.createDataFrame([("<s>[INST]user[/INST]a [INST] b</s><s>[INST]user[/INST]c</s>",)], "f string")
    assert [t.role for t in df.select(chat.parsed(F.col("f")).alias("t")).first().t] == [None, "user"]


def test_against_sql_on_control_strings(spark, tmp_path):
    """The registered SQL on conversations most of which hold control strings."""
    texts = ["see [INST] here", "and <s> or", "[/INST]", "</s>", r"<\s>", r"[\\/INST] x", "plain", None, "", "<s>[INST]user[/INST]x</s>"]
    rows = [(c, t, ["user", "assistant", "a[INST]", None][(c + t) % 4], texts[(c * 3 + t) % len(texts)]) for c in range(20) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = sorted(tuple(r[c] for c in names) for r in op6_chat_formatting(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == sorted(con.execute(f"select {', '.join(names)} from ({sql.CHAT})").fetchall())
