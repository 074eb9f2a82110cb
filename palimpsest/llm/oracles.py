"""DuckDB's SQL for the queries that SQL can express. It goes the plain way: brute force where the operators have sketches or filters."""

from __future__ import annotations

from . import quality as rules
from . import sharding as shards

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: The smallest id that links reach, for rows (id) and links (a, b) in both directions.
REACHED = "reached(id, root) as (select id, id from ids union select l.b, r.root from reached r join links l on l.a = r.id), roots as (select id, min(root) root from reached group by id)"


def minhash(similarity: float = 0.8) -> str:
    return f"""with recursive words as (select doc_id, {WORDS.replace("coalesce(text, '')", "lower(coalesce(text, ''))")} w from documents),
        sets as (select doc_id, g, length(bin(count(*))) w from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [list_aggregate(w, 'string_agg', ' ')]
          else list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) end) g from words) group by all),
        sizes as (select doc_id, sum(w) n from sets group by doc_id),
        met as (select a.doc_id a, b.doc_id b, sum(least(a.w, b.w)) n from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by all),
        pairs as (select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where met.n >= {similarity} * (x.n + y.n - met.n) - 1e-9),
        links as (select a, b from pairs union select b, a from pairs), ids as (select doc_id id from documents), {REACHED}
        select id doc_id, root class_id, id = root kept from roots"""


def sharding(n: int) -> str:
    draw = lambda j: f"('0x' || substr(md5(k || ':{j}'), 1, 13))::bigint"
    best = lambda many: f"(list_position([{', '.join(map(draw, range(many)))}], greatest({', '.join(map(draw, range(many)))})) - 1)::integer"
    return f"""with recursive bits(i, n, c) as (
          select i, 0, i::ubigint from range(256) r(i)
          union all select i, n + 1, case when c & 1 = 1 then xor(3988292384::ubigint, c >> 1) else c >> 1 end from bits where n < 8),
        lookup as (select list(c order by i) t from bits where n = 8),
        docs as (select doc_id, coalesce(cast(doc_id as varchar), '\\\\N') k, (strlen(coalesce(text, '')) + 8)::bigint size,
          list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::ubigint) bytes from documents),
        summed as (select doc_id, k, size,
          xor(4294967295::ubigint, list_reduce(bytes, lambda a, x: xor(t[(xor(a & 255, x) + 1)::int], a >> 8), 4294967295::ubigint))::bigint text_crc32 from docs, lookup),
        placed as (select *, {best(n)} shard, {best(n + 1)} grown_shard,
          ('0x' || substr(md5(k || ':' || text_crc32 || ':' || size), 1, 8))::bigint % greatest(64, (select count(*) from documents) // {shards.BUCKET_ROWS * n}) bucket from summed)
        select doc_id, size, text_crc32, 'key' law, shard, (row_number() over (partition by shard order by bucket, doc_id nulls first, text_crc32, size) - 1)::bigint slot, grown_shard from placed"""


def quality() -> str:
    sizes = {r.of: f"{r.of}::double" for r in rules.RULES} | {r.metric: f"{r.n} / {r.of}" for r in rules.RULES if not r.smooth}
    values = {r.metric: f"({r.n} + {float(r.smooth)!r}::double) / ({r.of} + t_{r.of})" if r.smooth else f"({r.n} + t_{r.of} * t_{r.metric}) / ({r.of} + t_{r.of})" for r in rules.RULES}
    bucket = lambda x: f"floor(ln({x}) / {rules.STEP}::double)::bigint"
    buckets = lambda of, given: " union all ".join(f"select lang, source, '{m}' metric, {bucket(x)} bucket from {given}" for m, x in of.items())
    percents = [10, 25, 50, 75, 90]
    wide = lambda near, far: f"(case when {near} = 0 then ({far}) / {rules.DECILE[1]}::double else greatest(({near}) / {rules.QUARTILE[1]}::double, least(({far}) / {rules.DECILE[1]}::double, {rules.TAIL}::double * (({near}) / {rules.QUARTILE[1]}::double))) end)"

    def spreads(name: str, of: str, by: str) -> str:
        quantiles = ", ".join(f"min(bucket) filter (100 * upto >= {q} * total) q{q}" for q in percents)
        up, down = wide("q75 - q50", "q90 - q50"), wide("q50 - q25", "q50 - q10")
        return f"""{name} as (select {by}metric, max(total) total, max(q50) middle, max({up}) up, max({down}) down from (select {by}metric, max(total) total, {quantiles}
            from (select {by}metric, bucket, sum(n) over (partition by {by}metric order by bucket) upto, sum(n) over (partition by {by}metric) total from (select {by}metric, bucket, count(*) n from {of} group by all)) group by {by}metric) group by {by}metric)"""

    def fences(name: str, of: str, by: str) -> str:
        high, low = f"middle + {rules.SPREAD}::double * greatest(up, wide)", f"middle - {rules.SPREAD}::double * greatest(down, deep)"
        columns = ", ".join(f"max({high}) filter (metric = '{r.metric}') high_{r.metric}, max({low}) filter (metric = '{r.metric}') low_{r.metric}" for r in rules.RULES)
        return f"{name} as (select {by}max(total) total, {columns} from {of} join usual using (metric) {f'group by {by[:-2]}' if by else ''})"

    pick = lambda c: f"case when o.total >= {rules.GROUP_ROWS} then o.{c} when l.total >= {rules.GROUP_ROWS} then l.{c} else a.{c} end"
    at = {m: bucket(x) for m, x in values.items()}
    inside = lambda r: f"({r.n} = 0 or {at[r.metric]} <= {pick(f'high_{r.metric}')})" if r.smooth else f"{at[r.metric]} between {pick(f'low_{r.metric}')} and {pick(f'high_{r.metric}')}"
    fits = " and ".join(f"coalesce({inside(r)}, true)" for r in rules.RULES)
    gap = r"[^\\x20\\x09-\\x0D]".replace("\\\\", "\\")
    return f"""with docs as (select doc_id, lang, source, coalesce(text, '') text, {WORDS} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{gap}')) lines, row_number() over () r from documents),
        grams as (select r, generate_subscripts(w, 1) i, w from docs where len(w) >= 5),
        keyed as (select r, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') g from grams where i <= len(w) - 4),
        twice as (select r, i from (select r, i, count(*) over (partition by r, g) n from keyed) where n > 1),
        covered as (select r, sum(reach) n from (select r, least(5, coalesce(lead(i) over (partition by r order by i) - i, 5)) reach from twice) group by r),
        measured as (select doc_id, lang, source, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
          (length(text) - length(regexp_replace(text, '{rules.SYMBOLS}', '', 'g')))::bigint n_symbols, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words, len(lines) __n_lines
          from docs left join covered using (r)),
        failed as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from measured),
        passed as (select distinct lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, __n_lines from failed where not base_failed),
        sizes as ({buckets(sizes, "passed")}), {spreads("sizes_s", "sizes", "")},
        typical as (select {', '.join(f"exp((max(middle) filter (metric = '{m}') + 0.5::double) * {rules.STEP}::double) t_{m}" for m in sizes)} from sizes_s),
        points as ({buckets(values, "passed, typical")}),
        {spreads("own_s", "points", "lang, source, ")}, {spreads("per_s", "points", "lang, ")}, {spreads("every_s", "points", "")},
        usual as (select metric, coalesce(median(up) filter (total >= {rules.GROUP_ROWS}), 0) / 2 wide, coalesce(median(down) filter (total >= {rules.GROUP_ROWS}), 0) / 2 deep from own_s group by metric),
        {fences("own", "own_s", "lang, source, ")}, {fences("per", "per_s", "lang, ")}, every as (select max(total) total, {', '.join(f"max(middle + {rules.SPREAD}::double * up) filter (metric = '{r.metric}') high_{r.metric}, max(middle - {rules.SPREAD}::double * down) filter (metric = '{r.metric}') low_{r.metric}" for r in rules.RULES)} from every_s)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {fits} kept
        from failed f left join typical on true left join own o on f.lang is not distinct from o.lang and f.source is not distinct from o.source left join per l on f.lang is not distinct from l.lang left join every a on true"""


def caps(cosine: float = 0.93) -> str:
    return f"""with recursive sound as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        unit as (select *, list_dot_product(e, e) s from sound),
        pairs as (select a.vec_id a, b.vec_id b from unit a join unit b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id < b.vec_id where list_dot_product(a.e, b.e) / sqrt(a.s * b.s) >= {cosine}),
        links as (select a, b from pairs union select b, a from pairs), ids as (select vec_id id from embeddings), {REACHED}, degree as (select a id, count(*) n from links group by a)
        select id vec_id, coalesce(n, 0)::bigint n_links, root component_id, id = root kept from roots left join degree using (id)"""
