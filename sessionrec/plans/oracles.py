"""DuckDB SQL for the registered queries.

Each query is written over named common table expressions; ``sql`` puts the ones a
query needs, directly or through others, in front of it.
"""

from __future__ import annotations

import re

from sessionrec.operators.features_item import CONVERSIONS, WINDOWS
from sessionrec.operators.item_cf import MERGED_AGGREGATIONS, RULES, PairRule
from sessionrec.operators.merge import ALL_GENERATORS, ITEM2VEC, ITEM_MF, USER_MF
from sessionrec.sources.events import EVENT_GROUPS

SPLIT = 1706054400  # 2024-01-24, the split of the fixtures
DAY = 86400

CTES: dict[str, str] = {}


def sql(query: str) -> str:
    """Prefix a query with the expressions it uses."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(query)
    if not needed:
        return query
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + query


def _in(types) -> str:
    return "(" + ", ".join(map(str, types)) + ")"


CTES["ev_all"] = """
  SELECT CAST(user_id AS INT) AS session,
         CAST(json_extract_string(props, '$.k') AS INT) AS aid,
         epoch_us(ts) // 1000000 AS ts,
         CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS TINYINT) AS type,
         event_id AS eid, event_type = 'error' AS failed
  FROM events"""
CTES["ev"] = "SELECT * EXCLUDE (failed) FROM ev_all WHERE NOT failed"
CTES["tr"] = f"SELECT * FROM ev WHERE ts < {SPLIT}"
CTES["later"] = f"SELECT * FROM ev WHERE ts >= {SPLIT}"
CTES["te"] = "SELECT * FROM tr WHERE session IN (SELECT session FROM later)"
CTES["basket"] = """
  SELECT CAST(o_custkey AS INT) AS session, CAST(l_partkey AS INT) AS aid,
         epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 AS ts,
         CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS TINYINT) AS type,
         l_partkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS eid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
CTES["truth"] = "SELECT DISTINCT session, type, aid FROM later"
CTES["truth_lists"] = (
    "SELECT session, type, list(aid ORDER BY aid) AS ground_truth FROM truth GROUP BY session, type"
)
for _log in ("tr", "basket"):
    CTES[f"dedup_{_log}"] = (
        f"SELECT session, aid, type, max(ts) AS ts FROM {_log} GROUP BY session, aid, type"
    )
    CTES[f"counts_{_log}"] = f"SELECT aid, count(*) AS c FROM dedup_{_log} GROUP BY aid"
    CTES[f"sizes_{_log}"] = f"SELECT session, count(*) AS n FROM {_log} GROUP BY session"
for _part, _log in (("train", "tr"), ("test", "te")):
    CTES[f"drawn_{_part}"] = f"""
  SELECT DISTINCT session FROM (
    SELECT session, row_number() OVER (ORDER BY session) - 1 AS place FROM (SELECT DISTINCT session FROM {_log}))
  WHERE place IN (
    SELECT CAST('0x' || substr(md5(concat_ws(':', '{_part}', draw, 77)), 1, 15) AS BIGINT)
             % (SELECT count(DISTINCT session) FROM {_log})
    FROM (SELECT unnest(range(CAST(floor((SELECT count(DISTINCT session) FROM {_log}) * 0.25e0) AS BIGINT))) AS draw))"""
CTES["numbered"] = """
  SELECT session, aid, eid, row_number() OVER (PARTITION BY session ORDER BY ts, eid) AS place,
         CAST('0x' || substr(md5(concat_ws(':', session, eid, 77)), 1, 15) AS BIGINT) % 5 + 1 AS reach
  FROM tr"""
CTES["contexts"] = """
  SELECT c.aid AS x, o.aid AS y,
         concat_ws(':', c.session, CASE WHEN o.place > c.place THEN c.eid ELSE o.eid END,
                   abs(o.place - c.place), CASE WHEN o.place > c.place THEN 'after' ELSE 'before' END) AS key
  FROM numbered c JOIN numbered o
    ON o.session = c.session AND o.place != c.place AND abs(o.place - c.place) <= c.reach"""
CTES["noise_range"] = """
  SELECT aid, CAST(sum(w) OVER (ORDER BY aid) - w AS BIGINT) AS start, CAST(sum(w) OVER (ORDER BY aid) AS BIGINT) AS stop
  FROM (SELECT aid, greatest(1, CAST(round(pow(count(*), 0.75) * 1024) AS BIGINT)) AS w FROM tr GROUP BY aid)"""
CTES["ids"] = """
  SELECT aid, CAST(row_number() OVER (ORDER BY aid) - 1 AS INT) AS aid_idx
  FROM (SELECT DISTINCT aid FROM tr)"""


def _pairs(tag: str, rule: PairRule, log: str, top: int) -> None:
    """Define ``w_<tag>`` (all weights) and ``p_<tag>`` (top neighbours)."""
    factors = []
    if rule.decay:
        factors.append("pow(2e0, -abs(l.ts - r.ts) / 3600e0)")
    if rule.trend:
        factors.append(f"(1e0 / ((SELECT max(ts) FROM {log}) - r.ts + 1))")
    if rule.session_size:
        factors.append("(1e0 / ln(1e0 + n))")
    weight = f"sum({' * '.join(factors or ['1e0'])})"
    if rule.popularity:
        weight += " / ln(sqrt(CAST(ca.c AS DOUBLE) * CAST(cb.c AS DOUBLE) + 2e0))"
    conditions = [f"l.type IN {_in(rule.source)}", f"r.type IN {_in(rule.target)}"]
    if rule.future:
        conditions.append("l.ts < r.ts")
    if rule.drop_self:
        conditions.append("l.aid <> r.aid")
    CTES[f"w_{tag}"] = f"""
  SELECT l.aid, r.aid AS aid_right, CAST({weight} AS FLOAT) AS weight
  FROM dedup_{log} l JOIN dedup_{log} r USING (session) JOIN sizes_{log} USING (session)
  JOIN counts_{log} ca ON ca.aid = l.aid JOIN counts_{log} cb ON cb.aid = r.aid
  WHERE {' AND '.join(conditions)} GROUP BY l.aid, r.aid, ca.c, cb.c"""
    CTES[f"p_{tag}"] = f"""
  SELECT aid, aid_right, weight FROM w_{tag}
  QUALIFY row_number() OVER (PARTITION BY aid ORDER BY weight DESC, aid_right) <= {top}"""


for _i, _rule in enumerate(RULES, 1):
    _pairs(f"r{_i}", _rule, "tr", 300)
_pairs("future", PairRule(future=True), "tr", 300)
_pairs("noself", PairRule(drop_self=True), "tr", 20)
_pairs("basket", PairRule(), "basket", 20)

_SCALE = {True: 1e6, False: 1.0}


def _pair_rows(tag: str, rule: PairRule) -> str:
    scale = "1e6" if rule.trend else "1e0"
    return (
        f"SELECT '{rule.name}' AS rule, aid, aid_right, "
        f"round(CAST(weight AS DOUBLE) * {scale}, 6) AS weight FROM p_{tag}"
    )


_RANKS = """CAST(row_number() OVER (PARTITION BY session, cg ORDER BY score DESC, aid) AS INT) AS rank,
  CAST(rank() OVER (PARTITION BY session, cg ORDER BY score DESC) AS INT) AS min_rank"""

for _g, _types in EVENT_GROUPS.items():
    CTES[f"h_{_g}"] = f"""
  SELECT session, aid, 'last_{_g}' AS cg, CAST(count(*) AS FLOAT) AS score
  FROM te WHERE type IN {_in(_types)} GROUP BY session, aid"""

for _i, _rule in enumerate(RULES, 1):
    CTES[f"j_r{_i}"] = f"""
  SELECT t.session, p.aid_right AS aid, CAST(p.weight AS DOUBLE) AS w,
         t.eid = t.newest AS is_last
  FROM (SELECT *, first_value(eid) OVER (PARTITION BY session ORDER BY ts DESC, eid DESC) AS newest
        FROM te WHERE type IN {_in(_rule.source)}) t JOIN p_r{_i} p ON p.aid = t.aid"""
    for _agg, _expr in {
        "sum": "sum(w)",
        "mean": "sum(w) / count(*)",
        "max": "max(w)",
        "min": "min(w)",
        "std": "stddev_samp(w)",
        "count": "CAST(count(*) AS DOUBLE)",
        "last": "sum(w)",
    }.items():
        _where = " WHERE is_last" if _agg == "last" else ""
        CTES[f"a_r{_i}_{_agg}"] = f"""
  SELECT session, aid, '{_rule.name}_{_agg}' AS cg, CAST({_expr} AS FLOAT) AS score
  FROM j_r{_i}{_where} GROUP BY session, aid"""
        CTES[f"c_r{_i}_{_agg}"] = f"""
  SELECT *, {_RANKS.replace('score DESC', 'score DESC NULLS LAST')} FROM a_r{_i}_{_agg}
  QUALIFY row_number() OVER (PARTITION BY session ORDER BY score DESC NULLS LAST, aid) <= 300"""

GENERATORS = [g.name for g in ALL_GENERATORS]
TOPS = {g.name: g.top for g in ALL_GENERATORS}
VOTES = {g.name: g.weight for g in ALL_GENERATORS}
TINY = [f"{r.name}_{a}" for r in RULES if r.trend for a in ("sum", "last")]
# The generators of fitted vectors use the given embeddings.
FITTED = {g.name: "last" if g.name.endswith("last") else "seq" for g in (*ITEM_MF, *USER_MF, *ITEM2VEC)}

CTES["hist"] = f"SELECT *, {_RANKS} FROM (" + " UNION ALL ".join(
    f"SELECT * FROM h_{g}" for g in EVENT_GROUPS
) + ")"
CTES["cand"] = " UNION ALL ".join(
    [
        "SELECT * FROM hist",
        *[f"SELECT * FROM c_r{i}_{a}" for i in range(1, len(RULES) + 1) for a in MERGED_AGGREGATIONS],
        *[f"SELECT session, aid, '{g}' AS cg, score, rank, min_rank FROM e_{seed}" for g, seed in FITTED.items()],
    ]
)
CTES["heads"] = "SELECT DISTINCT session, aid FROM cand WHERE " + " OR ".join(
    f"(cg = '{g}' AND rank <= {TOPS[g]})" for g in GENERATORS
)


def _wide() -> str:
    columns = ["h.session", "h.aid"]
    for g in GENERATORS:
        where = f"FILTER (WHERE c.cg = '{g}')"
        columns += [
            f"CAST(coalesce(max(c.rank) {where} <= {TOPS[g]}, FALSE) AS TINYINT) AS {g}_score_selected",
            f"coalesce(max(c.score) {where}, CAST(-1 AS FLOAT)) AS {g}_score",
            f"coalesce(max(c.rank) {where}, -1) AS {g}_score_rank",
            f"coalesce(max(c.min_rank) {where}, -1) AS {g}_score_min_rank",
        ]
    return (
        f"SELECT {', '.join(columns)} FROM heads h JOIN cand c ON c.session = h.session AND c.aid = h.aid "
        "GROUP BY h.session, h.aid"
    )


CTES["wide"] = _wide()
_weighted = " + ".join(f"{g}_score_selected * CAST({VOTES[g]} AS DOUBLE)" for g in GENERATORS)
_number = " + ".join(f"CAST({g}_score_selected AS INT)" for g in GENERATORS)
CTES["votes"] = f"""
  SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY cand_feature_selected_score DESC, aid) AS INT)
           AS cand_feature_selected_rank,
         CAST(rank() OVER (PARTITION BY session ORDER BY cand_feature_selected_score DESC) AS INT)
           AS cand_feature_selected_min_rank
  FROM (SELECT *, CAST({_number} AS TINYINT) AS cand_feature_selected_num,
               CAST({_weighted} AS FLOAT) AS cand_feature_selected_score FROM wide)"""
CTES["targets"] = """
  SELECT h.session, h.aid,
    CAST(coalesce(max(CAST(t.type = 0 AS INT)), 0) AS TINYINT) AS target_click,
    CAST(coalesce(max(CAST(t.type = 1 AS INT)), 0) AS TINYINT) AS target_cart,
    CAST(coalesce(max(CAST(t.type = 2 AS INT)), 0) AS TINYINT) AS target_order
  FROM heads h LEFT JOIN truth t ON t.session = h.session AND t.aid = h.aid
  GROUP BY h.session, h.aid"""
CTES["no_targets"] = """
  SELECT *,
    CAST(sum(target_click) OVER (PARTITION BY session) = 0 AS TINYINT) AS no_target_click,
    CAST(sum(target_cart) OVER (PARTITION BY session) = 0 AS TINYINT) AS no_target_cart,
    CAST(sum(target_order) OVER (PARTITION BY session) = 0 AS TINYINT) AS no_target_order
  FROM targets"""
CTES["labelled"] = """
  SELECT * FROM no_targets
  WHERE no_target_click = 0 OR no_target_cart = 0 OR no_target_order = 0"""
CTES["folds"] = """
  SELECT unnest(sessions) AS session, unnest(list_reduce(dealt, lambda a, b: {
      'n': b.n,
      'rows': list_transform(a.rows, lambda v, i: v + CASE WHEN i = list_position(a.rows, list_min(a.rows)) THEN b.n ELSE 0 END),
      'picked': list_append(a.picked, CAST(list_position(a.rows, list_min(a.rows)) - 1 AS TINYINT))},
    {'n': CAST(0 AS BIGINT), 'rows': CAST([0, 0, 0] AS BIGINT[]), 'picked': CAST([] AS TINYINT[])}).picked) AS fold
  FROM (SELECT list(session ORDER BY n DESC, session) AS sessions,
          list({'n': n, 'rows': CAST([] AS BIGINT[]), 'picked': CAST([] AS TINYINT[])} ORDER BY n DESC, session) AS dealt
        FROM (SELECT session, count(*) AS n FROM labelled GROUP BY session))"""
CTES["folded"] = "SELECT l.*, f.fold FROM labelled l JOIN folds f USING (session)"
CTES["sampled"] = """
  SELECT * FROM folded
  WHERE target_click = 1 OR target_cart = 1 OR target_order = 1
     OR substr(md5(concat_ws(':', session, aid, 77)), 1, 8) < '80000000'"""
CTES["trained"] = """
  SELECT *, greatest(target_click, target_cart, target_order) AS target_inter,
         greatest(target_cart, target_order) AS target_buy FROM sampled"""

# --- features -----------------------------------------------------------------


def _item_num() -> str:
    counts = [
        f"CAST(count(*) FILTER (WHERE ts >= m - {d} * {DAY} AND type IN {_in(t)}) AS INT) AS item_{g}_num_{d}d"
        for d in WINDOWS
        for g, t in EVENT_GROUPS.items()
    ]
    return f"""SELECT aid, {', '.join(counts)} FROM tr, (SELECT max(ts) AS m FROM tr)
  WHERE ts >= m - 21 * {DAY} GROUP BY aid"""


CTES["f_item_num"] = _item_num()
CTES["f_item_rank"] = "SELECT aid, " + ", ".join(
    f"""CAST(CASE WHEN item_{g}_num_{d}d > 0 THEN row_number()
  OVER (ORDER BY item_{g}_num_{d}d DESC, aid) ELSE 0 END AS INT) AS item_{g}_rank_{d}d"""
    for d in WINDOWS
    for g in EVENT_GROUPS
) + " FROM f_item_num"


def _ts_stats(key: str, prefix: str, log: str) -> str:
    return f"""SELECT {key}, (avg(ts) - any_value(m)) / any_value(s) AS {prefix}_ts_mean,
  (min(ts) - any_value(m)) / any_value(s) AS {prefix}_ts_min,
  (max(ts) - any_value(m)) / any_value(s) AS {prefix}_ts_max,
  (stddev_samp(ts) - any_value(m)) / any_value(s) AS {prefix}_ts_std
  FROM {log}, (SELECT avg(ts) AS m, stddev_samp(ts) AS s FROM {log}) GROUP BY {key}"""


CTES["f_item_ts"] = _ts_stats("aid", "item_inter", "tr")
CTES["f_user_ts"] = _ts_stats("session", "user_inter", "te")
CTES["f_item_multi"] = "SELECT aid, " + ", ".join(
    f"coalesce(avg(CASE WHEN n_{g} > 1 THEN 1e0 WHEN n_{g} = 1 THEN 0e0 END), -1e0) AS item_multi_{g}_prob"
    for g in EVENT_GROUPS
) + " FROM (SELECT session, aid, " + ", ".join(
    f"count(*) FILTER (WHERE type IN {_in(t)}) AS n_{g}" for g, t in EVENT_GROUPS.items()
) + " FROM tr GROUP BY session, aid) GROUP BY aid"


def _type_prob(recent: bool) -> str:
    op = ">=" if recent else "<"
    widest = max(WINDOWS) if recent else min(WINDOWS)
    counts = [
        f"count(*) FILTER (WHERE type = {t} AND ts {op} m - {d} * {DAY}) AS n{t}_{d}"
        for d in WINDOWS
        for t in (0, 1, 2)
    ]
    ratios = [
        f"CASE WHEN n{a}_{d} = 0 THEN -1e0 ELSE n{b}_{d} / n{a}_{d} END AS item_{name}_prob_{d}d"
        for d in WINDOWS
        for name, a, b in CONVERSIONS
    ]
    return f"""SELECT aid, {', '.join(ratios)} FROM (SELECT aid, {', '.join(counts)}
  FROM tr, (SELECT max(ts) AS m FROM tr) WHERE ts {op} m - {widest} * {DAY} GROUP BY aid)"""


CTES["f_item_prob"] = _type_prob(False)
CTES["f_item_prob_recent"] = _type_prob(True)
CTES["f_user_dow"] = "SELECT session, " + ", ".join(
    f"CAST(coalesce(isodow(to_timestamp({fn}(ts) FILTER (WHERE type IN {_in(t)})) AT TIME ZONE 'UTC') - 1, -1)"
    f" AS TINYINT) AS user_{which}_{g}_dow"
    for g, t in EVENT_GROUPS.items()
    for which, fn in (("first", "max"), ("last", "min"))
) + " FROM te GROUP BY session"
CTES["f_user_num"] = "SELECT session, " + ", ".join(
    f"CAST(coalesce(nullif(count(*) FILTER (WHERE type IN {_in(t)}), 0), -1) AS INT) AS user_{g}_num"
    for g, t in EVENT_GROUPS.items()
) + " FROM te GROUP BY session"
for _g, _types in EVENT_GROUPS.items():
    CTES[f"gap_{_g}"] = f"""
  SELECT session, min(d) AS mn, avg(d) AS me, stddev_samp(d) AS sd, max(d) AS mx FROM (
    SELECT session, lead(ts) OVER (PARTITION BY session ORDER BY ts, eid) - ts AS d
    FROM te WHERE type IN {_in(_types)}) GROUP BY session"""
CTES["f_user_gap"] = "SELECT s.session, " + ", ".join(
    f"coalesce(CAST(gap_{g}.{c} AS DOUBLE), -1e0) AS user_{g}_ts_diff_{n}"
    for g in EVENT_GROUPS
    for c, n in (("mn", "min"), ("me", "mean"), ("sd", "std"), ("mx", "max"))
) + " FROM (SELECT DISTINCT session FROM te) s " + " ".join(
    f"LEFT JOIN gap_{g} ON gap_{g}.session = s.session" for g in EVENT_GROUPS
)


def _user_hour(by_type: bool) -> str:
    def mean(types):
        only = f" FILTER (WHERE type IN {_in(types)})" if by_type else ""
        return f"avg((ts % {DAY}) // 3600){only}"

    return "SELECT session, " + ", ".join(
        f"CAST(trunc(coalesce({mean(t)}, -1)) AS TINYINT) AS user_{g}_ts_hour_mean"
        for g, t in EVENT_GROUPS.items()
    ) + " FROM te GROUP BY session"


CTES["f_user_hour"] = _user_hour(False)
CTES["f_user_hour_by_type"] = _user_hour(True)
CTES["f_user_ts_diff"] = """
  SELECT session, CAST(hi - lo AS INT) AS user_ts_diff,
    CAST(lo - all_lo AS INT) AS user_min_all_min_ts_diff,
    CAST(hi - all_lo AS INT) AS user_max_all_min_ts_diff,
    CAST(all_hi - lo AS INT) AS user_min_all_max_ts_diff,
    CAST(all_hi - hi AS INT) AS user_max_all_max_ts_diff
  FROM (SELECT session, min(ts) AS lo, max(ts) AS hi FROM te GROUP BY session),
       (SELECT min(ts) AS all_lo, max(ts) AS all_hi FROM te)"""
for _g, _types in EVENT_GROUPS.items():
    CTES[f"place_{_g}"] = f"""
  SELECT session, aid, min(f) AS f, min(l) AS l FROM (
    SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY ts DESC, eid DESC) - 1 AS f,
      row_number() OVER (PARTITION BY session ORDER BY ts, eid) - 1 AS l
    FROM te WHERE type IN {_in(_types)}) GROUP BY session, aid"""


def _item_place(by_type: bool) -> str:
    def value(column, g):
        if not by_type and (column == "l" or g not in ("inter", "buy")):
            return "-1"
        return f"coalesce(place_{g}.{column}, -1)"

    joins = " ".join(
        f"LEFT JOIN place_{g} ON place_{g}.session = i.session AND place_{g}.aid = i.aid"
        for g in EVENT_GROUPS
    )
    return "SELECT i.session, i.aid, " + ", ".join(
        f"CAST({value(c, g)} AS INT) AS user_item_{which}_{g}_rank"
        for which, c in (("first", "f"), ("last", "l"))
        for g in EVENT_GROUPS
    ) + f" FROM (SELECT DISTINCT session, aid FROM te) i {joins}"


CTES["f_user_item"] = _item_place(False)
CTES["f_user_item_by_type"] = _item_place(True)
CTES["ends"] = "SELECT session, " + ", ".join(
    f"{fn}(aid, ts * 1000000000 + eid) FILTER (WHERE type IN {_in(t)}) AS {which}_{g}"
    for g, t in EVENT_GROUPS.items()
    for which, fn in (("first", "arg_max"), ("last", "arg_min"))
) + " FROM te GROUP BY session"
_END_FLAGS = ", ".join(
    f"CAST(coalesce({which}_{g} = aid, FALSE) AS TINYINT) AS user_item_is_{which}_{g}"
    for g in EVENT_GROUPS
    for which in ("first", "last")
)
CTES["f_user_item_first"] = (
    f"SELECT session, aid, {_END_FLAGS} FROM (SELECT *, first_inter AS aid FROM ends)"
)
CTES["f_user_item_first_all"] = (
    f"SELECT session, aid, {_END_FLAGS} FROM ("
    + " UNION ".join(
        f"SELECT *, {which}_{g} AS aid FROM ends WHERE {which}_{g} IS NOT NULL"
        for g in EVENT_GROUPS
        for which in ("first", "last")
    )
    + ")"
)

# --- vectors ------------------------------------------------------------------

CTES["vecs"] = "SELECT CAST(vec_id AS INT) AS aid, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"
CTES["units"] = """
  SELECT aid, vec, sqrt(list_inner_product(vec, vec)) AS norm FROM vecs"""
CTES["q_last"] = """
  SELECT session, vec FROM (SELECT session, arg_max(aid, ts * 1000000000 + eid) AS aid FROM te GROUP BY session)
  JOIN vecs USING (aid)"""
CTES["q_seq_rows"] = """
  SELECT session, i, dim, any_value(1e0 - 0.05e0 * i) * any_value(vec[dim]) AS value
  FROM (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY ts DESC, eid DESC) - 1 AS r,
               count(*) OVER (PARTITION BY session) AS n
        FROM te SEMI JOIN vecs USING (aid)) s,
       (SELECT unnest(range(17)) AS i) p, (SELECT unnest(range(1, 65)) AS dim) d
       JOIN vecs ON TRUE
  WHERE vecs.aid = s.aid AND r = i % n GROUP BY session, i, dim"""
CTES["q_seq_values"] = "SELECT session, dim, sum(value) AS value FROM q_seq_rows GROUP BY session, dim"
CTES["q_seq"] = "SELECT session, list(value ORDER BY dim) AS vec FROM q_seq_values GROUP BY session"


def _search(queries: str, key: str, k: int) -> str:
    return f"""SELECT {key}, aid, score FROM (
  SELECT q.{key}, u.aid, round(list_inner_product(q.vec, u.vec)
         / (sqrt(list_inner_product(q.vec, q.vec)) * u.norm), 9) AS score
  FROM {queries} q, units u)
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, aid) <= {k}"""


for _seed in ("last", "seq"):
    CTES[f"e_{_seed}"] = f"""SELECT session, aid, score, {_RANKS.replace('session, cg', 'session')}
  FROM (SELECT session, aid, CAST(score AS FLOAT) AS score FROM ({_search(f'q_{_seed}', 'session', 300)}))"""


def _embedding_candidates(seed: str, cg: str) -> str:
    return (
        f"SELECT session, aid, '{cg}' AS cg, round(CAST(score AS DOUBLE), 6) AS score, rank, min_rank FROM e_{seed}"
    )


# --- lag pairs ----------------------------------------------------------------

CTES["indexed"] = "SELECT session, aid_idx, ts, eid FROM tr JOIN ids USING (aid)"
CTES["lags"] = " UNION ALL ".join(
    f"""SELECT aid_idx, next_aid_idx, ts_diff FROM (
    SELECT aid_idx, lead(aid_idx, {i}) OVER w AS next_aid_idx, ts - lead(ts, {i}) OVER w AS ts_diff
    FROM indexed WINDOW w AS (PARTITION BY session ORDER BY ts DESC, eid DESC))
  WHERE next_aid_idx IS NOT NULL"""
    for i in range(1, 5)
)
CTES["id_sizes"] = "SELECT aid_idx, count(*) AS n FROM indexed GROUP BY aid_idx"
CTES["coefs"] = """
  SELECT l.aid_idx, next_aid_idx, ts_diff,
         1e0 / x.n / (1e0 + ln(1e0 + least(604800, ts_diff) / 604800e0)) AS coef_x, 1e0 / y.n AS coef_y
  FROM lags l JOIN id_sizes x ON x.aid_idx = l.aid_idx JOIN id_sizes y ON y.aid_idx = next_aid_idx"""
CTES["eligible"] = """
  SELECT * FROM tr WHERE session IN (
    SELECT session FROM tr GROUP BY session HAVING count(*) >= 20 UNION SELECT session FROM te)"""

# --- evaluation ---------------------------------------------------------------

CTES["pred"] = """
  SELECT session, list(aid ORDER BY rank) AS y_pred FROM hist
  WHERE cg = 'last_inter' AND rank <= 20 GROUP BY session"""


def _recall(k: int, predicted: str) -> str:
    return f"""
  SELECT sum(hits) FILTER (WHERE type = 0) / sum(gt) FILTER (WHERE type = 0) AS recall_click,
         sum(hits) FILTER (WHERE type = 1) / sum(gt) FILTER (WHERE type = 1) AS recall_cart,
         sum(hits) FILTER (WHERE type = 2) / sum(gt) FILTER (WHERE type = 2) AS recall_order,
         avg(CAST(y_pred IS NULL AS INT)) AS null_ratio
  FROM (SELECT type, y_pred, least(len(ground_truth), {k}) AS gt,
               len(list_distinct(list_intersect(ground_truth, list_slice({predicted}, 1, {k})))) AS hits
        FROM truth_lists LEFT JOIN pred USING (session))"""


def _recall_row(k: int, predicted: str) -> str:
    return f"""SELECT round(recall_click, 6) AS recall_click, round(recall_cart, 6) AS recall_cart,
  round(recall_order, 6) AS recall_order,
  round(0.1e0 * recall_click + 0.3e0 * recall_cart + 0.6e0 * recall_order, 6) AS recall,
  round(null_ratio, 6) AS null_ratio FROM ({_recall(k, predicted)})"""


def _recall_curve() -> str:
    ks = (20, 50, 100, 200, 300)
    ratio = (
        "(sum(h{k}) FILTER (WHERE type = {t}) / sum(least(n, {k})) FILTER (WHERE type = {t}))"
    )
    columns = [
        f"round({ratio.format(k=20, t=t)}, 6) AS recall_{name}_20"
        for t, name in ((0, "click"), (1, "cart"), (2, "order"))
    ] + [
        "round("
        + " + ".join(f"{w}e0 * {ratio.format(k=k, t=t)}" for t, w in ((0, 0.1), (1, 0.3), (2, 0.6)))
        + f", 6) AS recall_{k}"
        for k in ks
    ]
    hits = ", ".join(f"count(*) FILTER (WHERE c.rank <= {k}) AS h{k}" for k in ks)
    return f"""SELECT {', '.join(columns)}, round(avg(missing), 6) AS null_ratio FROM (
  SELECT t.session, t.type, count(*) AS n, {hits},
         any_value(CAST(t.session NOT IN (SELECT session FROM hist WHERE cg = 'last_inter') AS INT)) AS missing
  FROM truth t LEFT JOIN hist c ON c.cg = 'last_inter' AND c.session = t.session AND c.aid = t.aid
  GROUP BY t.session, t.type)"""


def _rounded(names, digits=6) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) AS {n}" for n in names)


_USER_GAPS = [f"user_{g}_ts_diff_{s}" for g in EVENT_GROUPS for s in ("min", "mean", "std", "max")]
_PROBS = [f"item_{n}_prob_{d}d" for d in WINDOWS for n, _, _ in CONVERSIONS]
_MULTI = [f"item_multi_{g}_prob" for g in EVENT_GROUPS]
_ITEM_TS = [f"item_inter_ts_{s}" for s in ("mean", "min", "max", "std")]
_USER_TS = [f"user_inter_ts_{s}" for s in ("mean", "min", "max", "std")]


def _shown(generator: str) -> str:
    """A score as shown: tiny ones in millionths, -1 where there is none."""
    column = f"{generator}_score"
    value = f"CAST({column} AS DOUBLE)"
    if generator in TINY:
        value = f"CASE WHEN {column} >= 0 THEN {value} * 1e6 ELSE -1e0 END"
    return f"round({value}, 6) AS {column}"


_KEPT = [c for g in GENERATORS for c in (f"{g}_score_selected", f"{g}_score_rank", f"{g}_score_min_rank")]
_FEATURES_INT = [
    *[f"item_{g}_{k}_{d}d" for k in ("num", "rank") for d in WINDOWS for g in EVENT_GROUPS],
    *[f"user_item_{w}_{g}_rank" for w in ("first", "last") for g in EVENT_GROUPS],
    *[f"user_item_is_{w}_{g}" for g in EVENT_GROUPS for w in ("first", "last")],
    *[f"user_{w}_{g}_dow" for g in EVENT_GROUPS for w in ("first", "last")],
    *[f"user_{g}_num" for g in EVENT_GROUPS],
    *[f"user_{g}_ts_hour_mean" for g in EVENT_GROUPS],
    "user_ts_diff",
    *[f"user_{a}_all_{b}_ts_diff" for a in ("min", "max") for b in ("min", "max")],
]
_FILL = {}
for _c in _FEATURES_INT:
    _FILL[_c] = 0 if re.match(r"item_.*_(num|rank)_|user_item_is_", _c) else -1
_FILL |= {c: 0 for c in _ITEM_TS + _USER_TS}
_FILL |= {c: -1 for c in _USER_GAPS + _PROBS + _MULTI}
# Everything a ranker reads: votes, generator columns and the thirteen feature tables.
_RANK_FEATURES = [
    *[f"cand_feature_selected_{c}" for c in ("num", "score", "rank", "min_rank")],
    *[f"{g}_score" for g in GENERATORS],
    *_KEPT,
    *_FILL,
]


def _features() -> str:
    whole = ", ".join(f"CAST(coalesce({c}, {_FILL[c]}) AS INT) AS {c}" for c in _FEATURES_INT)
    real = ", ".join(
        f"round(CAST(CAST(coalesce({c}, {_FILL[c]}) AS FLOAT) AS DOUBLE), 3) AS {c}"
        for c in _ITEM_TS + _USER_TS + _USER_GAPS + _PROBS + _MULTI
    )
    return f"""SELECT session, aid, {whole}, {real} FROM heads
  LEFT JOIN f_item_num USING (aid) LEFT JOIN f_item_rank USING (aid) LEFT JOIN f_item_ts USING (aid)
  LEFT JOIN f_item_multi USING (aid) LEFT JOIN f_item_prob USING (aid)
  LEFT JOIN f_user_dow USING (session) LEFT JOIN f_user_num USING (session)
  LEFT JOIN f_user_gap USING (session) LEFT JOIN f_user_hour USING (session)
  LEFT JOIN f_user_ts USING (session) LEFT JOIN f_user_ts_diff USING (session)
  LEFT JOIN f_user_item USING (session, aid) LEFT JOIN f_user_item_first USING (session, aid)"""


def _ndcg() -> str:
    return """SELECT round(avg(dcg / idcg), 6) AS ndcg, count(*) AS sessions FROM (
  SELECT session, sum(CASE WHEN target_click = 1 AND r <= 20 THEN 1e0 / log2(r + 1) ELSE 0 END) AS dcg,
    list_sum([1e0 / log2(i + 1) FOR i IN range(1, CAST(least(sum(target_click), 20) AS BIGINT) + 1)]) AS idcg
  FROM (SELECT v.session, v.aid, target_click, row_number() OVER
          (PARTITION BY v.session ORDER BY cand_feature_selected_score DESC, v.aid) AS r
        FROM votes v JOIN targets t ON t.session = v.session AND t.aid = v.aid)
  GROUP BY session HAVING sum(target_click) > 0)"""


def oracle_sql() -> dict[str, str]:
    """SQL of every query that has one."""
    q: dict[str, str] = {
        "load_events": "SELECT * EXCLUDE (failed) FROM ev_all",
        "drop_error_events": "SELECT * FROM ev",
        "load_labels": "SELECT session, type, array_to_string(ground_truth, ',') AS ground_truth FROM truth_lists",
        "roundtrip_parquet": "SELECT * FROM tr",
        "train_plus_test": "SELECT * FROM ev",
        "filter_event_group": "SELECT * FROM tr WHERE type IN (1, 2)",
        "recent_days": f"SELECT * FROM tr WHERE ts >= (SELECT max(ts) FROM tr) - 7 * {DAY}",
        "older_days": f"SELECT * FROM tr WHERE ts < (SELECT max(ts) FROM tr) - 7 * {DAY}",
        "sample_sessions": """
          SELECT 'train' AS part, session, aid, ts, type, eid, '' AS ground_truth FROM tr
          WHERE session IN (FROM drawn_train UNION FROM drawn_test)
          UNION ALL SELECT 'test', *, '' FROM te WHERE session IN (FROM drawn_test)
          UNION ALL SELECT 'labels', session, -1, -1, type, -1, array_to_string(ground_truth, ',')
          FROM truth_lists WHERE session IN (FROM drawn_test)""",
        "skip_gram_pairs": "SELECT x, y, count(*) AS n FROM contexts GROUP BY x, y",
        "skip_gram_noise": "SELECT aid, start, stop FROM noise_range",
        "skip_gram_negatives": """
          SELECT x, z.aid AS y, count(*) AS n
          FROM (SELECT x, y AS own, CAST('0x' || substr(md5(concat_ws(':', key, draw, 77)), 1, 15) AS BIGINT)
                         % (SELECT max(stop) FROM noise_range) AS place
                FROM contexts, (SELECT unnest(range(1, 6)) AS draw)) t
          ASOF JOIN noise_range z ON t.place >= z.start
          WHERE z.aid != own GROUP BY x, z.aid""",
        "eligible_sessions": "SELECT session, count(*) AS events FROM eligible GROUP BY session",
        "dense_ids": "SELECT aid, aid_idx FROM ids",
        "dedup_latest": "SELECT * FROM dedup_tr",
        "item_value_counts": "SELECT aid, c AS counts FROM counts_tr",
        "session_item_pairs": """SELECT l.aid, r.aid AS aid_right, count(*) AS pairs,
          count(DISTINCT session) AS sessions FROM dedup_tr l JOIN dedup_tr r USING (session)
          GROUP BY l.aid, r.aid""",
        "pivot_type_counts": """SELECT aid, count(*) FILTER (WHERE type = 0) AS type_0,
          count(*) FILTER (WHERE type = 1) AS type_1, count(*) FILTER (WHERE type = 2) AS type_2
          FROM tr GROUP BY aid""",
        "outer_join_features": "SELECT aid, "
        + ", ".join(
            f"count(*) FILTER (WHERE type IN {_in(t)}) AS item_{g}_num" for g, t in EVENT_GROUPS.items()
        )
        + " FROM tr GROUP BY aid",
        "last_event": """SELECT session, arg_max(aid, k) AS aid, max(ts) AS ts, arg_max(type, k) AS type,
          arg_max(eid, k) AS eid FROM (SELECT *, ts * 1000000000 + eid AS k FROM basket) GROUP BY session""",
        "topk_per_group": """SELECT session, aid, CAST(score AS BIGINT) AS score,
          CAST(row_number() OVER (PARTITION BY session ORDER BY score DESC, aid) AS INT) AS rank
          FROM (SELECT session, aid, count(*) AS score FROM basket GROUP BY session, aid)
          QUALIFY row_number() OVER (PARTITION BY session ORDER BY score DESC, aid) <= 20""",
        "score_ranks": """SELECT session, aid, CAST(score AS DOUBLE) AS score,
          CAST(row_number() OVER (PARTITION BY session ORDER BY score DESC, aid) AS INT) AS rank,
          CAST(rank() OVER (PARTITION BY session ORDER BY score DESC) AS INT) AS min_rank
          FROM (SELECT session, aid, count(*) AS score FROM basket GROUP BY session, aid)""",
        "session_item_lists": """SELECT session, CAST(p // 1000 AS INT) AS part,
          string_agg(aid, ',' ORDER BY p) AS aids FROM (
            SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY ts, eid) - 1 AS p
            FROM basket) GROUP BY ALL""",
        "item_sentences": """SELECT session, CAST(p // 1000 AS INT) AS part,
          string_agg(aid, ' ' ORDER BY p) AS sentence FROM (
            SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY ts, eid) - 1 AS p
            FROM tr) GROUP BY ALL""",
        "lag_pairs": "SELECT aid_idx, next_aid_idx, ts_diff FROM lags",
        "pair_coefs": f"SELECT aid_idx, next_aid_idx, ts_diff, {_rounded(['coef_x', 'coef_y'], 9)} FROM coefs",
        "user_item_weights": """SELECT session, aid, round(1e0 / ln(1e0 + n), 6) AS weight FROM eligible
          JOIN (SELECT aid, count(*) AS n FROM eligible GROUP BY aid) USING (aid)""",
        "bpr_loss": """SELECT round(avg(-ln(1e-10 + 1e0 / (1e0 + exp(neg - pos)))), 6) AS loss, count(*) AS pairs
          FROM (SELECT list_inner_product(x.vec, y.vec) * coef_x * coef_y AS pos,
                       list_inner_product(x.vec, z.vec) * coef_x / s.n AS neg
                FROM coefs c
                JOIN ids ix ON ix.aid_idx = c.aid_idx JOIN vecs x ON x.aid = ix.aid
                JOIN ids iy ON iy.aid_idx = c.next_aid_idx JOIN vecs y ON y.aid = iy.aid
                JOIN ids iz ON iz.aid_idx = (c.next_aid_idx + 1) % (SELECT count(*) FROM ids)
                JOIN vecs z ON z.aid = iz.aid
                JOIN (SELECT next_aid_idx, 1e0 / max(coef_y) AS n FROM coefs GROUP BY next_aid_idx) s
                  ON s.next_aid_idx = iz.aid_idx)""",
        "bpr_strata": """SELECT round, cell, slice, CAST(sum(n) AS BIGINT) AS weight,
            round(-sum(n * ln(1e-10 + chance)) / sum(n), 6) AS loss,
            round(sum(-chance * (1e0 - chance) / (1e-10 + chance) * n
              * (cp * sy - cn * sn + cp * sx - cn * sx)) / sum(n), 6) AS gradient
          FROM bpr_steps GROUP BY round, cell, slice""",
        "item_cf_pairs": " UNION ALL ".join(_pair_rows(f"r{i}", r) for i, r in enumerate(RULES, 1)),
        "item_cf_future": _pair_rows("future", PairRule(future=True)),
        "item_cf_no_self": _pair_rows("noself", PairRule(drop_self=True)),
        "item_cf_pairs_basket": _pair_rows("basket", PairRule()),
        "vector_topk": _search("(SELECT aid AS seed, vec FROM vecs)", "seed", 20),
        "query_vec_last": """SELECT session, CAST(dim - 1 AS INT) AS dim, round(vec[dim], 6) AS value
          FROM q_last, (SELECT unnest(range(1, 65)) AS dim)""",
        "query_vec_seq": "SELECT session, CAST(dim - 1 AS INT) AS dim, round(value, 6) AS value FROM q_seq_values",
        "cand_embedding_last": _embedding_candidates("last", "embedding_last"),
        "cand_embedding_seq": _embedding_candidates("seq", "embedding_seq"),
        "merge_candidates": "SELECT session, aid FROM heads",
        "candidate_scores_wide": f"SELECT session, aid, {', '.join(_KEPT)}, {', '.join(map(_shown, GENERATORS))} FROM wide",
        "candidate_votes": f"""SELECT session, aid, cand_feature_selected_num,
          {_rounded(['cand_feature_selected_score'])}, cand_feature_selected_rank,
          cand_feature_selected_min_rank FROM votes""",
        "label_candidates": "SELECT * FROM labelled",
        "drop_no_target_sessions": "SELECT * FROM labelled",
        "group_kfold": "SELECT session, fold FROM folds",
        "negative_sample": "SELECT * FROM sampled",
        "shuffle_within_session": """SELECT session, aid, CAST(row_number() OVER (PARTITION BY session
          ORDER BY md5(concat_ws(':', session, aid, 77))) AS INT) AS position FROM sampled""",
        "derive_targets": """SELECT session, aid, target_inter, target_buy FROM trained
          WHERE no_target_cart = 0 OR target_order = 1""",
        "derive_targets_session": """SELECT session, aid, target_inter, target_buy FROM trained
          WHERE no_target_cart = 0 OR no_target_order = 0""",
        "fold_split": """SELECT session, aid, target_click, fold,
          CASE WHEN fold = 0 THEN 'valid' ELSE 'train' END AS part FROM trained WHERE no_target_click = 0""",
        "pairwise_examples": """SELECT p.session, p.aid AS pos_aid, n.aid AS neg_aid,
          round(abs(p.d - n.d) / list_sum([1e0 / log2(i + 1) FOR i IN range(1, CAST(least(p.n, 20) AS BIGINT) + 1)]), 6) AS weight,
          round(CAST(p.cand_feature_selected_score AS DOUBLE) - n.cand_feature_selected_score, 6) AS vote_diff
          FROM (SELECT * FROM ranked_click WHERE target_click = 1) p
          JOIN (SELECT * FROM ranked_click WHERE target_click = 0) n USING (session)""",
        "lambda_gradients": """SELECT session, aid, round(gradient, 6) + 0e0 AS gradient,
          round(hessian, 6) AS hessian FROM lambda_rows""",
        "lambda_root_splits": """SELECT 'cand_feature_selected_num' AS feature, bin, n,
          round(g, 4) + 0e0 AS g, round(h, 4) AS h,
          round(g * g / (h + 1e0) + (g_all - g) * (g_all - g) / (h_all - h + 1e0) - g_all * g_all / (h_all + 1e0), 4) + 0e0 AS gain
          FROM lambda_bins WHERE n >= 20 AND n_all - n >= 20""",
        "candidates_with_features": _features(),
        "model_roundtrip": "SELECT session, aid, TRUE AS same FROM labelled",
        "score_candidates": """SELECT session, aid, 'pairwise' AS model, 'target_buy' AS target, fold,
          TRUE AS finite FROM folded""",
        "feature_importance": " UNION ALL ".join(
            f"SELECT '{name}' AS feature, 3e0 AS total"
            for name in _RANK_FEATURES
        ),
        "topk_lists": """SELECT session, string_agg(aid, ',' ORDER BY cand_feature_selected_rank) AS y_pred
          FROM votes WHERE cand_feature_selected_rank <= 20 GROUP BY session""",
        "ndcg_at_20": _ndcg(),
        "recall_at_k": _recall_row(20, "coalesce(y_pred, [])"),
        "recall_padded": _recall_row(
            20,
            """list_concat(coalesce(y_pred, []), CASE WHEN type = 0
               THEN (SELECT list(aid ORDER BY n DESC, aid) FROM popular WHERE type = 0)
               ELSE (SELECT list(aid ORDER BY n DESC, aid) FROM popular WHERE type = 2) END)""",
        ),
        "recall_curve": _recall_curve(),
        "recall_curve_merged": _recall_curve()
        .replace("hist WHERE cg = 'last_inter'", "votes")
        .replace("hist c ON c.cg = 'last_inter' AND", "votes c ON")
        .replace("c.rank", "c.cand_feature_selected_rank"),
        "feat_item_inter_num": "SELECT * FROM f_item_num",
        "feat_item_inter_rank": "SELECT * FROM f_item_rank",
        "feat_item_ts_stats": f"SELECT aid, {_rounded(_ITEM_TS)} FROM f_item_ts",
        "feat_item_multi_prob": f"SELECT aid, {_rounded(_MULTI)} FROM f_item_multi",
        "feat_item_type_prob": f"SELECT aid, {_rounded(_PROBS)} FROM f_item_prob",
        "feat_item_type_prob_recent": f"SELECT aid, {_rounded(_PROBS)} FROM f_item_prob_recent",
        "feat_user_dow": "SELECT * FROM f_user_dow",
        "feat_user_inter_num": "SELECT * FROM f_user_num",
        "feat_user_ts_gap": f"SELECT session, {_rounded(_USER_GAPS)} FROM f_user_gap",
        "feat_user_hour": "SELECT * FROM f_user_hour",
        "feat_user_hour_by_type": "SELECT * FROM f_user_hour_by_type",
        "feat_user_ts_stats": f"SELECT session, {_rounded(_USER_TS)} FROM f_user_ts",
        "feat_user_ts_diff": "SELECT * FROM f_user_ts_diff",
        "feat_user_item_rank": "SELECT * FROM f_user_item",
        "feat_user_item_rank_by_type": "SELECT * FROM f_user_item_by_type",
        "feat_user_item_is_first": "SELECT * FROM f_user_item_first",
        "feat_user_item_is_first_all_pairs": "SELECT * FROM f_user_item_first_all",
    }
    for i, rule in enumerate(RULES, 1):
        q[f"item_cf_pairs_rule{i}"] = _pair_rows(f"r{i}", rule)
    for g in EVENT_GROUPS:
        q[f"cand_last_{g}"] = (
            f"SELECT session, aid, cg, CAST(score AS DOUBLE) AS score, rank, min_rank FROM hist"
            f" WHERE cg = 'last_{g}'"
        )
    for agg in ("sum", "mean", "max", "min", "std", "count"):
        q[f"item_cf_agg_{agg}"] = (
            f"SELECT session, aid, round(CAST(score AS DOUBLE), 6) AS score FROM a_r1_{agg}"
        )
    for agg in ("sum", "mean", "max", "min", "std", "count", "last"):
        q[f"cand_item_cf_{agg}"] = (
            "SELECT session, aid, cg, round(CAST(score AS DOUBLE), 6) AS score, rank, min_rank "
            f"FROM c_r1_{agg}"
        )
    q["cand_item_cf_all_rules"] = " UNION ALL ".join(
        f"SELECT session, aid, cg, round(CAST(score AS DOUBLE) * {'1e6' if r.trend and a != 'count' else '1e0'}, 6)"
        f" AS score, rank, min_rank FROM c_r{i}_{a}"
        for i, r in enumerate(RULES, 1)
        for a in ("sum", "last", "count")
    )
    return {name: sql(text) for name, text in q.items()}


CTES["bpr_dealt"] = """
  SELECT *, greatest(ceil(count(*) OVER (PARTITION BY round, cell) / 5000e0), 1)::BIGINT AS slices
  FROM (SELECT c.aid_idx AS x, next_aid_idx AS y, coef_x, coef_y, count(*) AS n,
               CAST((c.aid_idx % 4 + next_aid_idx % 4) % 4 AS INT) AS round,
               CAST(least(c.aid_idx % 4, next_aid_idx % 4) AS INT) AS cell,
               CAST('0x' || substr(md5(concat_ws(':', c.aid_idx, next_aid_idx, ts_diff, 77)), 1, 13) AS BIGINT) AS draw
        FROM coefs c WHERE c.aid_idx IN (SELECT aid_idx FROM ids JOIN vecs USING (aid))
          AND next_aid_idx IN (SELECT aid_idx FROM ids JOIN vecs USING (aid))
        GROUP BY c.aid_idx, next_aid_idx, ts_diff, coef_x, coef_y)"""
CTES["bpr_placed"] = """
  SELECT *, row_number() OVER (p ORDER BY draw, x, y, coef_x, coef_y) - 1 AS place, count(*) OVER p AS size
  FROM (SELECT *, draw % slices AS slice FROM bpr_dealt)
  WINDOW p AS (PARTITION BY round, cell, slice)"""
CTES["bpr_steps"] = """
  SELECT a.round, a.cell, a.slice, a.n, a.coef_x * a.coef_y AS cp, a.coef_x * o.coef_y AS cn,
         list_inner_product(vx.vec, vy.vec) AS pos, list_inner_product(vx.vec, vn.vec) AS neg,
         list_sum(vx.vec) AS sx, list_sum(vy.vec) AS sy, list_sum(vn.vec) AS sn,
         1e0 / (1e0 + exp(neg * cn - pos * cp)) AS chance
  FROM bpr_placed a JOIN bpr_placed o
    ON o.round = a.round AND o.cell = a.cell AND o.slice = a.slice AND o.place = (a.draw // a.slices) % a.size
  JOIN ids ix ON ix.aid_idx = a.x JOIN vecs vx ON vx.aid = ix.aid
  JOIN ids iy ON iy.aid_idx = a.y JOIN vecs vy ON vy.aid = iy.aid
  JOIN ids jn ON jn.aid_idx = o.y JOIN vecs vn ON vn.aid = jn.aid"""
CTES["popular"] = """
  SELECT type, aid, n FROM (SELECT type, aid, count(*) AS n FROM tr GROUP BY type, aid)
  QUALIFY row_number() OVER (PARTITION BY type ORDER BY n DESC, aid) <= 20"""
CTES["ranked_click"] = """
  SELECT session, aid, target_click, cand_feature_selected_score,
         CASE WHEN r <= 20 THEN 1e0 / log2(r + 1) ELSE 0e0 END AS d,
         sum(target_click) OVER (PARTITION BY session) AS n
  FROM (SELECT s.session, s.aid, s.target_click, v.cand_feature_selected_score,
          row_number() OVER (PARTITION BY s.session ORDER BY v.cand_feature_selected_score DESC, s.aid) AS r
        FROM trained s JOIN votes v ON v.session = s.session AND v.aid = s.aid
        WHERE s.no_target_click = 0)"""
CTES["lambda_pairs"] = """
  SELECT p.session, p.aid AS pos, n.aid AS neg,
         abs(p.d - n.d) / list_sum([1e0 / log2(i + 1) FOR i IN range(1, CAST(least(p.n, 20) AS BIGINT) + 1)]) AS worth,
         1e0 / (1e0 + exp(CAST(p.cand_feature_selected_score AS DOUBLE) - n.cand_feature_selected_score)) AS behind
  FROM ranked_click p JOIN ranked_click n USING (session) WHERE p.target_click = 1 AND n.target_click = 0"""
CTES["lambda_rows"] = """
  SELECT r.session, r.aid, coalesce(s.g, 0e0) AS gradient, coalesce(s.h, 0e0) AS hessian
  FROM ranked_click r LEFT JOIN (
    SELECT session, aid, sum(g) AS g, sum(h) AS h FROM (
      SELECT session, pos AS aid, -worth * behind AS g, worth * behind * (1e0 - behind) AS h FROM lambda_pairs
      UNION ALL
      SELECT session, neg, worth * behind, worth * behind * (1e0 - behind) FROM lambda_pairs)
    GROUP BY session, aid) s USING (session, aid)"""
CTES["lambda_bins"] = """
  SELECT bin, CAST(sum(n) OVER up AS BIGINT) AS n, sum(g) OVER up AS g, sum(h) OVER up AS h,
         sum(n) OVER () AS n_all, sum(g) OVER () AS g_all, sum(h) OVER () AS h_all
  FROM (SELECT CAST(greatest(cand_feature_selected_num - 1, 0) AS INT) AS bin, count(*) AS n,
          -- sums in whole units, as the histograms hold them
          sum(CAST(round(gradient * 16777216) AS BIGINT)) / 16777216e0 AS g,
          sum(CAST(round(hessian * 16777216) AS BIGINT)) / 16777216e0 AS h
        FROM lambda_rows JOIN votes USING (session, aid) GROUP BY 1)
  WINDOW up AS (ORDER BY bin)"""
