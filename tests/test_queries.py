"""Every query of the core library, against its SQL where it has one."""

import pytest

import lodeworks.queries as Q

from .compare import rows


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, sf, duck, name):
    got = Q.QUERIES[name](spark, sf).toPandas()
    if name in Q.ORACLE:
        assert rows(got) == rows(duck.sql(Q.ORACLE[name]).df())
    else:
        assert len(got.columns) > 0


def naive_bulk(ops, versions, immutable, program_only):
    """Each operation by itself, against a plain list of what the log has of its path."""
    log, sent, out = {}, {}, {}
    for v in versions:
        log.setdefault(v.path, {})[v.version] = (v.deleted, v.length, v.hash)
    under = lambda path, ps: any((path + "/").startswith(p + "/") for p in ps)
    for o in sorted(ops, key=lambda o: o.ordinal):
        mine = log.setdefault(o.path, {})
        top = max(mine, default=None)
        live = top is not None and not mine[top][0]
        request = (o.op, o.expected, o.hash, o.length)
        if o.command_id is not None and (o.path, o.command_id) in sent:
            old, result = sent[o.path, o.command_id]
            out[o.ordinal] = (*result, True) if old == request else ("command_conflict", None, False)
            continue
        result, replay = None, False
        if under(o.path, program_only):
            result = ("program_only", top)
        elif under(o.path, immutable) != (o.op == "put_immutable"):
            result = ("immutable" if under(o.path, immutable) else "not_immutable_prefix", top)
        elif o.op == "put_if_absent" and live:
            result = ("exists", top)
        elif o.op.endswith("if_version") and top != o.expected:
            result = ("version_mismatch", top)
        elif o.op == "put_immutable" and live:
            replay = mine[top][1:] == (o.length, o.hash)
            result = ("ok" if replay else "immutable", top)
        elif o.op == "delete_version":
            if o.expected not in mine:
                result = ("not_deleted", None)
            elif o.expected == top and mine[top][0]:
                result = ("current_tombstone", top)
            else:
                result = ("ok", o.version if o.expected == top else None)
                if o.expected == top:
                    mine[o.version] = (True, None, None)
                del mine[o.expected]
        else:
            mine[o.version] = (True, None, None) if o.op.startswith("delete") else (False, o.length, o.hash)
            result = ("ok", o.version)
        out[o.ordinal] = (*result, replay)
        if o.command_id is not None and result[0] in ("ok", "not_deleted"):
            sent[o.path, o.command_id] = (request, result)
    return out, {(p, v, *x) for p, vs in log.items() for v, x in vs.items()}


def test_bulk_writes_brute_force(spark, sf):
    ops, base = Q._ops(spark, sf), Q._base(spark, sf)
    rows, before = ops.collect(), base.collect()
    for name, immutable, program_only in (("m07_bulk_write", ["users/1", "users/2"], ["users/3"]), ("m04_m06_log_after", ["users/1"], [])):
        outcomes, log = naive_bulk(rows, before, immutable, program_only)
        got = Q.QUERIES[name](spark, sf).collect()
        if name == "m07_bulk_write":
            assert {r.ordinal: (r.outcome, r.version, r.replayed) for r in got} == outcomes and len({r.outcome for r in got}) > 5
        else:
            assert {(r.path, r.version, r.deleted, r.length, r.hash) for r in got} == log and len(got) == len(log)


def test_next_token_counts_pages_of_50(spark, sf, monkeypatch):
    """Over 2000 parts the pages stay of 50, and those reported are those fetched."""
    limits, fetch = [], Q.search.fetch
    monkeypatch.setattr(Q.search, "fetch", lambda *a, **k: (limits.append(k["limit"]), fetch(*a, **k))[1])
    got = Q.QUERIES["r08_next_token"](spark, sf.replace("sf0.001", "sf0.01")).first()
    assert set(limits) == {50} and got.pages == len(limits) == got.hits // 50 + 1 and got.last_is_short


def test_next_token_reads_ahead(spark, sf):
    """41 pages cost far fewer jobs than pages."""
    sc = spark.sparkContext
    sc.setJobGroup("r08", "pages")
    try:
        got = Q.QUERIES["r08_next_token"](spark, sf.replace("sf0.001", "sf0.01")).first()
        jobs = len(sc.statusTracker().getJobIdsForGroup("r08"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got.pages == 41 and 1 < jobs < 20


def test_verify_normalises_once(spark, sf):
    """The join of o05_verify works no package's name out, on neither side."""
    plan = Q.QUERIES["o05_verify"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "regexp_replace" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
