"""SQL of the queries that SQL can express, for one engine's dialect (DuckDB)."""

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Links to components: every row with every row that it reaches.
REACH = """
both_ways as (select a, b from links union select b, a from links),
reach as (select r as a, r as b from nodes union select reach.a, l.b from reach join both_ways l on reach.b = l.a)"""

JACCARD = f"""
with recursive words as (
    select row_number() over () as r, doc_id,
           [x for x in string_split_regex(translate(coalesce(text, ''), {LETTERS}), '[\\x20\\x09-\\x0D]+') if x <> ''] as w
    from documents
), sets as (
    select r, doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end as s
    from words
), members as (select r, len(s) as n, unnest(s) as x from sets),
links as (
    select a.r as a, b.r as b from members a join members b on a.x = b.x and a.r < b.r and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    group by a.r, b.r, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), nodes as (select r from sets),{REACH}
select s.doc_id, len(s.s) as n_shingles, min(t.doc_id) as component_id
from sets s join reach on reach.a = s.r join sets t on t.r = reach.b group by s.r, s.doc_id, s.s
"""

#: The same with the number of links of each row.
JACCARD_LINKS = JACCARD.replace("as n_shingles,", "as n_shingles, (select count(*) from both_ways l where l.a = s.r) as n_links,")

NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"""({NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Places of the matches: the lengths of the stretches between them and of the matches before."""
    return f"""
    select doc_id, r, '{kind}' as kind, {order} as k, unnest(list_zip(string_split_regex(text, '{pattern}')[1:len(found)], found, inner_part, range(1, len(found) + 1)),
        recursive := false) as m, found, string_split_regex(text, '{pattern}') as gaps, {least} as least
    from (select doc_id, r, text, regexp_extract_all(text, '{pattern}') as found, regexp_extract_all(text, '{pattern}', {group}) as inner_part from d)"""


SECRETS = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
m as ({_matches("assign", 0, ASSIGN, 2, 6)} union all {_matches("access", 1, "AKIA[A-Z0-9]+", 0, 20)} union all {_matches("hex", 2, "[0-9a-f]+", 0, 24)}),
places as (
    select r, kind, k, cast(list_sum([length(g) for g in gaps[1:m[4]]]) + coalesce(list_sum([length(f) for f in found[1:m[4] - 1]]), 0) as bigint) as a, length(m[2]) as n
    from m where length(m[3]) >= least
), spans as (
    select r, string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, k) as spans, count(*) filter (k = 0) as n_assign,
           count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex
    from places group by r
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join spans using (r)
"""

NEAR_VECTORS = f"""
with recursive v as (
    select row_number() over () as r, vec_id, case when embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
        and len([x for x in embedding if x <> 0]) > 0 then cast(embedding as double[]) end as x
    from embeddings
), links as (
    select a.r as a, b.r as b from v a join v b on a.r < b.r and len(a.x) = len(b.x)
    where list_dot_product(a.x, b.x) >= 0.9 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))
), nodes as (select r from v),{REACH},
counts as (select a, count(*) as n from both_ways group by a),
named as (select reach.a, min(v.vec_id) as c from reach join v on v.r = reach.b group by reach.a)
select v.vec_id, coalesce(counts.n, 0) as n_links, named.c as component_id, v.vec_id = named.c as kept
from v join named on named.a = v.r left join counts on counts.a = v.r
"""

TOP_K = """
with v as (
    select vec_id, [cast(floor(256 * cast(x as double)) as hugeint) for x in embedding] as x
    from embeddings
    where vec_id is not null and embedding is not null
      and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), pairs as (
    select q.vec_id as query_id, c.vec_id,
           cast(coalesce(list_sum([q.x[i] * c.x[i] for i in range(1, least(len(q.x), len(c.x)) + 1)]), 0) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id
    where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank", vec_id, score
from pairs
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""

#: CRC-32 of the decimal digits of a number: eight shifts for each digit.
CRC_OF_ID = """xor(4294967295, list_reduce([cast(4294967295 as bigint)] || [cast(ord(c) as bigint) for c in string_split(cast(doc_id as varchar), '')],
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, step: xor(c >> 1, 3988292384 * (c & 1)))))"""


def _written(field: str) -> str:
    return f"coalesce(strlen(cast({field} as varchar)) || ':' || {field}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_written(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Nodes by level: runs of 16 until one is left, by source and then over the sources; every leaf walks up.
MERKLE = f"""
with recursive rows as (
    select row_number() over () as r, doc_id, coalesce('=' || source, '') as tree, {_leaf("text")} as leaf,
           case when {CRC_OF_ID} % 5 = 0 then {_leaf(f"translate(text, {LETTERS})")} else {_leaf("text")} end as changed
    from documents
), leaves as (
    select *, row_number() over (partition by tree order by doc_id nulls first, leaf, r) - 1 as idx, count(*) over (partition by tree) as n from rows
), nodes as (
    select tree, 0 as level, cast(idx as bigint) as idx, cast(n as bigint) as n, leaf as hash from leaves
    union all
    select tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(hash, '' order by idx)) from nodes where n > 1 group by tree, level, idx // 16, n
), subroots as (
    select tree as name, level as height, hash, cast(row_number() over (order by tree) - 1 as bigint) as idx, count(*) over () as n from nodes where n = 1
), tops as (
    select 'top' as tree, 0 as level, idx, cast(n as bigint) as n, hash from subroots
    union all
    select tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(hash, '' order by idx)) from tops where n > 1 group by tree, level, idx // 16, n
), all_nodes as (select * from nodes union all select * from tops),
beside as (
    select a.tree, a.level, a.idx, a.n, coalesce(string_agg(b.hash, '' order by b.idx) filter (b.idx < a.idx), '') as lefts,
           coalesce(string_agg(b.hash, '' order by b.idx) filter (b.idx > a.idx), '') as rights
    from all_nodes a join all_nodes b on a.tree = b.tree and a.level = b.level and a.idx // 16 = b.idx // 16 where a.n > 1 group by all
), walk as (
    select r, tree, 0 as level, cast(idx as bigint) as idx, '' as proof, changed as folded from leaves
    union all
    select w.r, case when s.name is null then w.tree else 'top' end, case when s.name is null then w.level + 1 else 0 end,
           case when s.name is null then w.idx // 16 else s.idx end,
           proof || coalesce(lefts || rights, ''), case when b.tree is null then folded else sha256(lefts || folded || rights) end
    from walk w left join beside b on b.tree = w.tree and b.level = w.level and b.idx = w.idx
    left join subroots s on b.tree is null and s.name = w.tree and w.tree <> 'top'
    where b.tree is not null or s.name is not null
), ends as (select r, arg_max(struct_pack(proof := proof, folded := folded), (tree = 'top', level)) as e from walk group by r),
root as (select hash as root from tops where n = 1)
select l.doc_id, l.leaf, s.hash as subroot, root, sha256(e.proof) as proof_sha256, e.folded as folded_root, e.folded = root as verified
from leaves l join ends using (r) join subroots s on s.name = l.tree cross join root
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = f"""
with d as (
    select row_number() over () as r, doc_id, unnest(regexp_extract_all(translate(text, {LETTERS}), '{TERM}')) as term from documents where text is not null
), counts as (select r, doc_id, term, count(*) as tf from d group by all),
lengths as (select r, cast(sum(tf) as bigint) as n from counts group by r),
total as (select count(*) as docs, cast(sum(n) as bigint) as terms from lengths),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from counts, total group by term, docs),
items as (select row_number() over () as i, item_id, text from (select distinct item_id, text from benchmark where text is not null)),
asked as (select i, item_id, unnest(regexp_extract_all(translate(text, {LETTERS}), '{TERM}')) as term from items),
scores as (
    select i, item_id, doc_id, c.r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) as bigint) as score
    from asked join counts c using (term) join weights using (term) join lengths on lengths.r = c.r, total group by all
)
select item_id, cast(row_number() over w as integer) as "rank", doc_id, score
from scores where score > 0
window w as (partition by i order by score desc, doc_id nulls last)
qualify row_number() over w <= 10
"""
