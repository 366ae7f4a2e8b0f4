"""Traffic-shaped views over the shared test tables, one text for both engines where their dialects agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view: (views and tables it reads, text). {us}, {s} and {div} are the epoch in microseconds, the text type and whole division.
_TEXTS: dict[str, tuple[list[str], str]] = {
    "e": (
        ["events"],
        "select event_id, user_id, event_type, value, props, {us} as e_us, concat('10.0.', cast(user_id {div} 256 as {s}), '.', cast(user_id % 256 as {s})) as ip, "
        "concat('203.0.113.', cast(event_id % 3 as {s})) as srv from events",
    ),
    "steps": (["e"], "select event_id, user_id, e_us, ip, srv, {unroll} as i from e"),
    "packets": (
        ["steps"],
        "select event_id, i, case when fwd then c_ip else s_ip end as src_ip, cast(case when fwd then c_port else s_port end as int) as src_port, "
        "case when fwd then s_ip else c_ip end as dst_ip, cast(case when fwd then s_port else c_port end as int) as dst_port, 'TCP' as protocol, ts_us, ip_length, tcp_flags from ("
        "select event_id, i, ip as c_ip, 50000 + user_id % 7 as c_port, srv as s_ip, case event_id % 4 when 0 then 443 when 1 then 80 when 2 then 22 else 4444 end as s_port, "
        "e_us + i * (case event_id % 5 when 0 then 20000 when 1 then 300000 when 2 then 4000000 when 3 then 9000000 else 1000000 end) "
        "+ case when event_id % 5 = 4 and i >= 8 then 35000000 else 0 end as ts_us, (i = 0 or (event_id + i) % 3 <> 1) as fwd, "
        "cast(54 + (event_id * 31 + i * 17) % 1447 as int) as ip_length, "
        "cast(case when i = 0 and event_id % 6 <> 0 then 2 when i = 1 then 18 when i = event_id % 29 and event_id % 2 = 0 then 17 else 16 end as int) as tcp_flags from steps) p",
    ),
    "alerts": (
        ["e"],
        "select concat('a', cast(event_id as {s})) as alert_id, concat('C', cast(event_id as {s})) as uid, concat('s', cast(event_id % 5 as {s})) as sensor_id, ip as src_ip, srv as dst_ip, "
        "cast(50000 + user_id % 7 as int) as src_port, cast(case event_id % 4 when 0 then 443 when 1 then 80 when 2 then 22 else 4444 end as int) as dst_port, "
        "e_us as start_us, e_us + (event_id % 90) * 1000000 as end_us, cast((event_id * 7919) % 10007 as double) / 10007 as prob, event_id from e where event_type = 'error'",
    ),
    "conn": (["e"], "select concat('C', cast(event_id as {s})) as uid, ip as orig_h, srv as resp_h, e_us as ts_us from e where event_type in ('view', 'click')"),
    "ids": (
        ["e"],
        "select event_id, ip as src_ip, srv as dest_ip, e_us as ts_us, case event_id % 3 when 0 then 'C2 Beacon' when 1 then 'Port Scan' else 'Policy' end as signature "
        "from e where event_type = 'purchase'",
    ),
    "beats": (
        ["e"],
        "select concat('s', cast(user_id % 8 as {s})) as sensor_id, event_id, e_us as observed_us, event_id % 1000 as received, event_id % 7 as dropped from e where event_type = 'signup'",
    ),
    "samples": (
        ["documents", "labels"],
        "select d.doc_id as id, l.toxic as label, l.quality as predicted, d.source as source from documents d join labels l on d.doc_id = l.doc_id where l.toxic is not null",
    ),
    "cases": (
        ["orders"],
        "select o_orderkey as case_id, concat('k', cast(o_custkey as {s})) as alert_key, case o_orderstatus when 'O' then 'new' when 'P' then 'in_review' else 'escalated' end as status, "
        "{order_us} as created_us from orders",
    ),
    "decisions": (
        ["lineitem"],
        "select l_orderkey as case_id, l_linenumber as seq, case (l_partkey + l_linenumber) % 5 when 0 then 'closed' when 1 then 'in_review' when 2 then 'escalated' when 3 then 'new' else 'bogus' end as status, "
        "case when l_returnflag = 'R' then 'false_positive' when l_returnflag = 'A' then 'true_positive' else '' end as disposition, concat('o', cast(l_suppkey % 5 as {s})) as owner, "
        "case when l_linestatus = 'F' then 'checked' else '' end as reason, {ship_us} as decided_us from lineitem",
    ),
}
_DIALECTS = {
    "spark": {"us": "unix_micros(cast(ts as timestamp))", "s": "string", "div": "div", "unroll": "explode(sequence(0L, event_id % 29))", "order_us": "unix_micros(cast(o_orderdate as timestamp))", "ship_us": "unix_micros(cast(l_shipdate as timestamp))"},
    "duck": {"us": "epoch_us(ts)", "s": "varchar", "div": "//", "unroll": "unnest(range(0, 1 + event_id % 29))", "order_us": "epoch_us(o_orderdate)", "ship_us": "epoch_us(l_shipdate)"},
}


def view(spark: SparkSession, sf_dir: str, name: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The view, or the table of that name. Given tables, streams too, take the place of those in the folder."""
    if name not in _TEXTS:
        return tables[name] if name in (tables or {}) else spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, text = _TEXTS[name]
    for need in needs:
        text = text.replace(f"from {need}", f"from {{{need}}}").replace(f"join {need} ", f"join {{{need}}} ")
    for token, value in _DIALECTS["spark"].items():
        text = text.replace(f"{{{token}}}", value)
    return spark.sql(text, **{need: view(spark, sf_dir, need, tables) for need in needs})


#: Events that a task unrolls to packets, about 15 each.
UNROLLED = 100_000


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets view with its events dealt to tasks: a small compressed file holds many of them, and a task's memory grows with its packets."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return view(spark, sf_dir, "packets", {"events": events.repartition(-(-events.count() // UNROLLED) or 1)})


def duck(*names: str) -> str:
    """Common table expressions of the views and what they need, for DuckDB; ends in a comma so that others can follow."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in _TEXTS and name not in order:
            for need in _TEXTS[name][0]:
                add(need)
            order.append(name)

    for name in names:
        add(name)
    texts = []
    for name in order:
        text = _TEXTS[name][1]
        for token, value in _DIALECTS["duck"].items():
            text = text.replace(f"{{{token}}}", value)
        texts.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(texts) + ",\n"


def portable_hash(*parts: str) -> str:
    """sampling.portable_hash in DuckDB."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"
