"""The relationship model over a sales schema: the same views for Spark and, as SQL text, for a reference engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "people": """select c_custkey as id, c_name as name, c_nationkey = 0 as is_warm, case when c_mktsegment = 'MACHINERY' then concat('Q', cast(c_custkey as varchar(20))) end as qid,
        greatest(0, cast(floor(c_acctbal / 500) as int)) as sitelinks from customer""",
    "orgs": """select p_partkey as id, p_name as name, case cast(floor(p_partkey / 50.0) as bigint) % 4 when 0 then 'firm' when 1 then 'company' when 2 then 'nonprofit' else 'event' end as type from part where p_partkey % 50 = 0""",
    "memberships": """select o_custkey as person, l_partkey as org, min(l_orderkey * 10 + l_linenumber) as seq from lineitem join orders on l_orderkey = o_orderkey where l_partkey % 50 = 0 group by o_custkey, l_partkey""",
    "ties": """select l_orderkey * 10 + l_linenumber as seq, concat('C', cast(o_custkey as varchar(20))) as person_1, concat('S', cast(l_suppkey as varchar(20))) as person_2,
        case substring(o_orderpriority, 1, 1) when '1' then 'cofounder' when '2' then 'board_member' when '3' then 'colleague' when '4' then 'shared_portfolio' else 'co_speaker' end as rtype,
        concat('order://', cast(l_orderkey as varchar(20))) as source_url, concat('line ', cast(l_linenumber as varchar(20))) as evidence from lineitem join orders on l_orderkey = o_orderkey""",
    "claims": """select concat('Q', cast(o_custkey as varchar(20))) as subject, case l_linenumber when 1 then 'P463' when 2 then 'P108' when 4 then 'P54' when 6 then 'P26' else 'P40' end as prop,
        case when l_linenumber in (6, 7) then concat('Q', cast(l_suppkey * 7 + l_linenumber as varchar(20))) else concat('O', cast(l_partkey % 200 as varchar(20))) end as target, min(l_orderkey) as pos
        from lineitem join orders on l_orderkey = o_orderkey where l_linenumber in (1, 2, 4, 6, 7) group by 1, 2, 3
        union all select concat('O', cast(l_partkey % 200 as varchar(20))), case l_linenumber when 3 then 'P161' else 'P112' end, concat('Q', cast(o_custkey as varchar(20))), min(l_orderkey)
        from lineitem join orders on l_orderkey = o_orderkey where l_linenumber in (3, 5) and l_quantity > 20 group by 1, 2, 3
        union all select concat('Q', cast(c_custkey as varchar(20))), 'P31', 'Q5', cast(0 as bigint) from customer where c_custkey % 10 <> 9
        union all select concat('O', cast(p_partkey as varchar(20))), 'P31', concat('K', cast(p_size % 8 as varchar(20))), cast(0 as bigint) from part where p_partkey < 200""",
    "known_labels": """select concat('Q', cast(c_custkey as varchar(20))) as id, case when c_custkey % 13 = 0 then concat('Q', cast(c_custkey as varchar(20))) when c_custkey % 17 = 0 then null else c_name end as label from customer
        union all select concat('O', cast(p_partkey as varchar(20))), case when p_partkey % 7 = 3 then null else p_name end from part where p_partkey < 200
        union all select concat('K', cast(n_nationkey as varchar(20))), case n_nationkey when 0 then 'Learned society' when 1 then 'order of merit' when 2 then 'political coalition' when 3 then 'Academy' when 4 then 'football club' when 5 then 'musical ensemble' when 6 then 'business enterprise' else 'trade union' end from nation where n_nationkey < 8""",
    "officers": """select l_partkey as company, l_linenumber as pos, concat('Person ', cast(l_suppkey as varchar(20))) as name, case l_linenumber when 1 then 'Chairman' when 2 then 'Secretary' when 3 then 'Managing Director' else null end as position
        from (select l_partkey, l_linenumber, max(l_suppkey) as l_suppkey from lineitem where l_partkey % 4 = 0 group by l_partkey, l_linenumber) x""",
    "asserted": """select person_1 as a, person_2 as b, rtype, min(seq) as seq, min(case when seq % 3 = 0 then concat('org', cast(seq % 40 as varchar(20))) end) as org from ties where seq % 5 = 0 group by person_1, person_2, rtype""",
    "sparse_ties": """select person_1 as a, person_2 as b, rtype, source_url, min(evidence) as evidence from ties where seq % 70 = 5 group by person_1, person_2, rtype, source_url""",
    "sparse_people": """select concat('C', cast(c_custkey as varchar(20))) as id, c_name as name, c_nationkey = 0 as is_warm, case when c_custkey % 4 = 0 then concat('Q', cast(c_custkey as varchar(20))) end as qid, cast(c_custkey % 11 as int) as sitelinks from customer
        union all select concat('S', cast(s_suppkey as varchar(20))), s_name, false, case when s_suppkey % 5 = 0 then concat('Q', cast(s_suppkey as varchar(20))) end, cast(s_suppkey % 9 as int) from supplier""",
    "investments": """select l_suppkey as firm, l_partkey as company, min(l_orderkey * 10 + l_linenumber) as seq from lineitem where l_partkey % 50 = 0 group by l_suppkey, l_partkey""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, over the tables of a folder."""
    import re

    sql, used = VIEWS[name], {}
    if name in ("asserted", "sparse_ties"):
        sql = sql.replace("from ties", f"from ({VIEWS['ties']}) t")
    for t in ("customer", "supplier", "part", "lineitem", "orders", "nation"):
        if re.search(rf"\b(from|join) {t}\b", sql):
            used[t] = table(spark, sf_dir, t)
            sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """The SQL text with the views it names as common table expressions."""
    import re

    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql + (" ties" if re.search(r"\b(asserted|sparse_ties)\b", sql) else ""))]
    if not used:
        return sql
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in used)
    if sql.lstrip().lower().startswith("with recursive"):
        return f"with recursive {head}, " + sql.lstrip()[len("with recursive") :]
    if sql.lstrip().lower().startswith("with"):
        return f"with {head}, " + sql.lstrip()[len("with") :]
    return f"with {head} {sql}"
