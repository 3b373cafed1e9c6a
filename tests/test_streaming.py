import pytest

from spindrift.plans.compiler import Project
from spindrift.queries import PROJECT
from spindrift.streaming import live, rates, sinks


@pytest.mark.parametrize("text,want", [("250/s", 250), ("8 per minute", 8 / 60), ("1200/hour", 1 / 3), ("86400/day", 1), ("5", 5), (7, 7)])
def test_rates(text, want):
    assert rates.parse(text) == pytest.approx(want)


@pytest.mark.parametrize("text", ["fast", "0/s", "5/fortnight"])
def test_bad_rates(text):
    with pytest.raises(ValueError):
        rates.parse(text)


def test_bucket_attains_its_targets():
    now = [0.0]
    b = rates.Bucket(100, 1.0, clock=lambda: now[0])
    b.due()
    for i in range(100):
        now[0] += 0.1
        b.due()
        if i == 49:
            b.retarget(200)
    assert b.taken == pytest.approx(1500, abs=2) and b.attainment == pytest.approx(1, abs=0.01)
    now[0] += 1000
    assert b.due() <= 200


def test_sinks_by_uri(tmp_path):
    kinds = {"stdout:": sinks.Stdout, "memory:": sinks.Memory, f"file://{tmp_path}/x": sinks.Files, "udp://h:99": sinks.Syslog, "tcp://h": sinks.Syslog, "https://h/x?body=array": sinks.Http, "kafka://h:9092/topic?key=id": sinks.Kafka}
    for uri, kind in kinds.items():
        assert isinstance(sinks.of(uri), kind), uri
    assert sinks.syslog_line("b", now="T").startswith("<134>1 T ")


class Broken(sinks.Sink):
    def __call__(self, batch, epoch):
        raise OSError("down")


def test_a_stream_is_exact_and_goes_on(spark, tmp_path):
    p = Project(PROJECT, spark)
    memory, broken = sinks.Memory(1000), Broken()
    stream = live.Live(p, {"employee": "500/s"}, [memory, broken, sinks.Files(f"file://{tmp_path}/out")], start={"employee": 30})
    stats = stream.run(max_records=120, pause=0.05)
    assert stats.generated == 120 and broken.failed == 120 and stream.next == {"employee": 150}
    batch = {r._index: r for r in p.frame("employee", 30, 120).collect()}
    assert sorted(r["_index"] for r in memory.rows) == list(range(30, 150))
    for r in memory.rows:
        assert r["email"] == batch[r["_index"]].email
    assert spark.read.text(f"{tmp_path}/out").count() == 120
    with pytest.raises(OSError):
        live.Live(p, {"employee": "500/s"}, [Broken()], on_error="abort").run(max_records=5, pause=0.05)


def test_simulated_streams(spark):
    p = Project(PROJECT, spark)
    rows = live.projection(p, "login", spark.range(3000).withColumnRenamed("id", "_index")).toPandas()
    shares = rows.groupby("employee").size().sort_values(ascending=False)
    assert abs(shares.head(50).sum() / 3000 - 0.1 ** (1 / 1.8)) < 0.06
    assert rows.mail.notna().all()


def test_rate_source(spark, tmp_path):
    p = Project(PROJECT, spark)
    memory = sinks.Memory(10_000)
    q = live.streaming(p, "company", "20/s", [memory], checkpoint=str(tmp_path / "cp"))
    try:
        for _ in range(30):
            q.awaitTermination(1)
            if memory.rows:
                break
    finally:
        q.stop()
    assert {"company_id", "domain"} <= set(memory.rows[0])


LEDGER = {
    "project": {"name": "ledger", "seed": 5},
    "entities": {
        "account": {"count": 6, "fields": {"account_id": {"type": "integer", "generator": {"type": "sequence", "start": 100}, "primary_key": True}}},
        "payment": {"count": 1000, "simulation": {"subject": "account", "distribution": "skewed", "skew": 1.5, "state": {"balance": {"initial": 50, "update": "balance + amount", "min": 0, "precision": 2}, "n": {"initial": 0, "update": "n + 1"}}}, "fields": {
            "payment_id": {"type": "integer", "generator": "sequence"}, "account": {"generator": "subject"}, "amount": {"type": "float", "generator": {"type": "expression", "expression": "(payment_id * 37) % 300 - 140"}},
            "balance": {"type": "float", "generator": "state"}, "n": {"type": "integer", "generator": "state"}, "rich": {"type": "boolean", "generator": {"type": "expression", "expression": "balance > 100"}}}},
    },
}


def folded(rows):
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: r["_index"]):
        b, n = state.get(r["account"], (50, 0))
        state[r["account"]] = out[r["_index"]] = (round(max(0, b + r["amount"]), 2), n + 1)
    return out


def test_a_stream_carries_the_state_of_its_subjects(spark):
    p, memory = Project(LEDGER, spark), sinks.Memory(1000)
    stream = live.Live(p, {"payment": "400/s"}, [memory], validate="report")
    stats = stream.run(max_records=150, pause=0.05)
    assert stream.epoch > 1 and stats.invalid == 0 and stats.current_rate > 0
    want = folded(memory.rows)
    assert len(want) == 150 and {r["_index"]: (r["balance"], r["n"]) for r in memory.rows} == want
    assert all(r["rich"] == (r["balance"] > 100) for r in memory.rows)
    assert sum(s[0] for s in stream.state["payment"].values()) == 150


def test_a_long_history_is_folded(spark):
    p = Project(LEDGER, spark)
    rows = [r.asDict() for r in p.frame("payment").collect()]
    assert {r["_index"]: (r["balance"], r["n"]) for r in rows} == folded(rows)


def test_a_stream_drops_what_fails(spark):
    spec = {**LEDGER, "entities": {**LEDGER["entities"], "payment": {**LEDGER["entities"]["payment"], "assertions": ["amount > 0"]}}}
    memory = sinks.Memory(1000)
    stats = live.Live(Project(spec, spark), {"payment": "400/s"}, [memory], validate="skip").run(max_records=60, pause=0.05)
    assert 0 < stats.invalid < 60 and len(memory.rows) == 60 - stats.invalid and all(r["amount"] > 0 for r in memory.rows)
