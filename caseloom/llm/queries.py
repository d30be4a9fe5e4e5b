"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_extract, language, license_scan, ngram_join, packing, quality, repair, secrets, token_counts, token_store, vector_codes
from ._common import read_table, scratch


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], turns.schema))
    out = chat.format_trees(chat.nodes_of_turns(turns), per_tree=None).withColumn("parts", chat.segments(F.col("formatted")))
    read = out.select(
        F.col("tree_id").alias("conv_id"),
        F.size("parts").cast("long").alias("n_turns"),
        F.transform("parts", chat.parse).alias("turns"),
        F.array_join(chat.loss_texts(F.col("parts"), F.col("loss_spans")), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    token_store.write_store(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op3_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the licence scan that SQL can express: all but what the method adds."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        F.size(F.filter("live", lambda x: x)).cast("long").alias("n_live"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Of five parts of the documents, one is never learned from.
FOLDS = 5


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # A null id counts as an empty one, which is held out.
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0
    field = language.fit(docs.where(~held_out))
    found = language.identify(docs, field)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


def damaged(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows after damage by the checksum of ``conv_id:turn``, and the ids of dropped rows."""
    name = F.concat_ws(":", *(F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn")))
    rows = turns.select("conv_id", "turn", *(F.coalesce(n, F.lit(" ")).alias(n) for n in ("role", "text")), (F.crc32(name) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    left = rows.where("harm <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")
    return left, rows.where("harm = 0").select("conv_id")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(*damaged(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_token_store": op2_token_store,
        "op3_license_scan": op3_license_scan,
        "op3_base": op3_base,
        "op4_secret_scan": op4_secret_scan,
        "op5_decontaminate": op5_decontaminate,
        "op6_ngram_join": op6_ngram_join,
        "op7_quality_rules": op7_quality_rules,
        "op8_packing": op8_packing,
        "op9_html_extract": op9_html_extract,
        "op10_token_counts": op10_token_counts,
        "op11_language_id": op11_language_id,
        "op12_vector_codes": op12_vector_codes,
        "op13_structure_repair": op13_structure_repair,
    }


#: A text with its backslashes doubled and its control strings opened has this many characters more.
_ADDED = """length({0}) - length(replace({0}, chr(92), ''))
  + length(regexp_extract_all({0}, '<\\|[A-Za-z_]+\\|>|</?s>|<</?SYS>>|\\[/?INST\\]'))"""

OP1_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<|im_start|>') + 1 + length('<|im_end|>') + 1 + length(role) + length(text)
    + {_ADDED.format("role")} + {_ADDED.format("text")}) as bigint) as formatted_chars
from turns group by conv_id
"""

OP3_BASE_SQL = """
with words as (select row_number() over () as rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
phrases(phrase, label) as (values (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')),
hits as (select rid, label, unnest(list_filter(range(1, len(w) + 1), lambda k: w[k:k + len(phrase) - 1] = phrase)) - 1 as place
  from words, phrases where list_contains(w, 'license'))
select doc_id, cast(len(w) as bigint) as n_words, count(place) as n_base, min(place) as first_word, max(place) as last_word,
  coalesce(string_agg(distinct label, ',' order by label), '') as base_labels
from words left join hits using (rid) group by rid, doc_id, w
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# Matches with their places: the pieces between them and their own lengths, summed up.
_MATCHES = "union all".join(
    f"""
  select rid, {kind} as kind, k, length(whole) as n, value,
    sum(length(gap) + length(whole)) over (partition by rid order by k) as stop
  from (select rid, unnest(regexp_extract_all(text, {_quoted(pattern)})) as whole, unnest(regexp_extract_all(text, {_quoted(pattern)}, {group})) as value,
      unnest(list_slice(regexp_split_to_array(text, {_quoted(pattern)}), 1, -2)) as gap,
      generate_subscripts(regexp_extract_all(text, {_quoted(pattern)}), 1) as k
    from docs where regexp_matches(text, {_quoted(pattern)}))
  """
    for kind, pattern, group in (
        (0, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
        (1, "AKIA[A-Z0-9]+", 0),
        (2, "[0-9a-f]+", 0),
        (3, secrets.OTHER, 0),
    )
)

OP4_SQL = f"""
with docs as (select row_number() over () as rid, doc_id, source, lang, coalesce(text, '') as text from documents),
found as (select *, stop - n as start from ({_MATCHES})
  where kind = 3 or kind = 0 and length(value) >= 6 or kind = 1 and n >= 20 or kind = 2 and n >= 24),
held as (select value, count(distinct coalesce(source, chr(1))) as owners, count(distinct coalesce(source, chr(1)) || chr(2) || coalesce(lang, chr(1))) as repos
  from found join docs using (rid) group by value),
judged as (select f.*, not regexp_matches(f.value, '{secrets.STOCK}') and owners <= {secrets.MAX_OWNERS} and repos <= {secrets.MAX_REPOS} as live,
    ['assign', 'access', 'hex', 'other'][kind + 1] || ':' || start || ':' || stop as span
  from found f join held using (value)),
told as (select rid, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
    string_agg(span, ',' order by start, kind) filter (where kind < 3) as base, string_agg(span, ',' order by start, kind) as spans, count(*) filter (where live) as n_live
  from judged where kind < 3 or live group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live
from docs left join told using (rid)
"""

# Every pair of documents with a shingle in common, then the smallest id that links reach, round by round.
OP6_SQL = """
with recursive words as (
  select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (select rid, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [hash(array_to_string(w, ' '))]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda k: hash(w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] || ' ' || w[k + 4])))) end as own from words),
kinds as (select own, min(doc_id) as doc_id, row_number() over () as kid from sets where len(own) > 0 group by own),
items as (select kid, unnest(own) as item from kinds),
links as (select a.kid as a, b.kid as b from items a join items b on a.item = b.item and a.kid <> b.kid
  join kinds x on x.kid = a.kid join kinds y on y.kid = b.kid
  group by a.kid, b.kid, len(x.own), len(y.own) having 100 * count(*) >= 80 * (len(x.own) + len(y.own) - count(*))),
reach(kid, near) as (select kid, kid from kinds union select r.kid, l.b from reach r join links l on r.near = l.a),
least as (select r.kid, min(k.doc_id) as component_id from reach r join kinds k on k.kid = r.near group by r.kid)
select s.doc_id, cast(len(s.own) as bigint) as n_shingles, coalesce(l.component_id, s.doc_id) as component_id
from sets s left join kinds k on s.own = k.own and len(s.own) > 0 left join least l on l.kid = k.kid
"""


# The rounds one by one, every part against every entry.
_ROUND = """
near{k} as (select rid, part, min(d * 256 + entry) as m from (
  select rid, part, entry, sum((x - z) * (x - z)) as d from parts join books{k} using (part, place) group by rid, part, entry) group by rid, part),
books{next} as (select part, entry, place, coalesce((s - ((s % n) + n) % n) // n, z) as z from books{k} left join (
  select part, m % 256 as entry, place, sum(x) as s, count(*) as n from near{k} join parts using (rid, part) group by part, m % 256, place) using (part, entry, place))"""
OP12_SQL = f"""
with kept as (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
places as (select rid, unnest(v) as x, generate_subscripts(v, 1) - 1 as i, len(v) // 4 as width from kept),
parts as (select rid, x, i // width as part, i % width as place from places),
books0 as (select part, entry, place, x as z from parts join (
  select rid, row_number() over (order by vec_id, v) - 1 as entry from kept qualify entry < 256) using (rid)),
{",".join(_ROUND.format(k=k, next=k + 1) for k in range(4))},
last as (select rid, part, min(d * 256 + entry) as m from (
  select rid, part, entry, sum((x - z) * (x - z)) as d from parts join books4 using (part, place) group by rid, part, entry) group by rid, part),
coded as (select rid, string_agg(printf('%02x', cast(m % 256 as integer)), '' order by part) as code, cast(sum(m // 256) as bigint) as error from last group by rid),
named as (select sha256(string_agg(cast(cast(z as bigint) as varchar), ',' order by part, entry, place)) as codebooks_sha256 from books4)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept join coded using (rid), named
"""

# CRC-32 of ASCII text: eight steps a bit for each byte.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda r, z: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)))"""


def _step(state: str, cost: str, letter: str, line: str | None) -> str:
    """A way's text (cost, letters, chr(1), repaired lines) with one edit more; the least text is the cheapest way, and of these the least letters."""
    cut = f"instr({state}, chr(1))"
    more = f" || case when {cut} = length({state}) then '' else chr(10) end || {line}" if line else ""
    return (
        f"case when {state} is not null then lpad(cast(cast({state}[1:9] as bigint) + {cost} as varchar), 9, '0')"
        f" || {state}[10:{cut} - 1] || '{letter}' || {state}[{cut}:]{more} end"
    )


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


# A row is [role, text, must go, cut off]; a state list has the best way to each state before the row's own inserts.
_INSERTED = f"""list_transform([list_transform([a], lambda w: [w[1], w[2], {_least('w[3]', *(_step(f'w[{k}]', '2', 'I', "'user:'") for k in (1, 2, 4)))}, w[4]])[1]],
  lambda w: [w[1], w[2], w[3], {_least('w[4]', _step('w[3]', '2', 'I', "'assistant:'"))}])[1]"""


def _kept(initial: str, *states: int) -> list[str]:
    return [f"case when r[3] = '' and r[1][1:1] = '{initial}' then {_step(f'w[{k}]', 'cast(r[4] as bigint)', 'K', 'r[1] || chr(58) || r[2]')} end" for k in states]


def _changed(role: str, *states: int) -> list[str]:
    return [f"case when r[3] = '' then {_step(f'w[{k}]', '2 + cast(r[4] as bigint)', 'R', f'{chr(39)}{role}:{chr(39)} || r[2]')} end" for k in states]


_ROW = f"""list_transform([{_INSERTED}], lambda w: [
  {_step('w[1]', '3', 'D', None)}, {_least(_step('w[2]', '3', 'D', None), *_kept('s', 1))},
  {_least(_step('w[3]', '3', 'D', None), *_kept('u', 1, 2, 4), *_changed('user', 1, 2, 4))},
  {_least(_step('w[4]', '3', 'D', None), *_kept('a', 3), *_changed('assistant', 3))}])[1]"""

OP13_SQL = f"""
with named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
harmed as (select *, {_CRC} % 20 as harm from named),
left_over as (select conv_id, turn, case when harm = 4 then 'user' else role end as role,
    case when harm = 1 then '' when harm = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when harm = 3 then [0, 1] else [0] end) as time
  from harmed where harm <> 0),
rows as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, time) as k,
    row_number() over (partition by conv_id, role, text order by turn nulls first, time) > 1 as seen from left_over),
faults as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when seen then 'duplicate'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') then 'truncated' else '' end as fault,
    lag(role[1:1]) over (partition by conv_id order by k) || role[1:1] as neighbours from rows),
folded as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (where fault = 'blank') as blank,
    count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where neighbours not in ('su', 'ua', 'au')) as illegal,
    list_reduce(list_prepend(['000000000' || chr(1), null, null, null]::varchar[],
      list([role, text, case when fault in ('blank', 'duplicate') then 'x' else '' end, case when fault = 'truncated' then '1' else '0' end] order by k)),
      lambda a, r: {_ROW}) as a
  from faults group by conv_id),
ended as (select *, list_transform([{_INSERTED}], lambda w: {_least('w[1]', 'w[4]')})[1] as best from folded)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, cast(coalesce(best[1:9], '0') as bigint) as cost, coalesce(best[10:instr(best, chr(1)) - 1], '') as audit,
  sha256(coalesce(best[instr(best, chr(1)) + 1:], '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join ended e on o.conv_id is not distinct from e.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: it has no tokenizers, no xxhash64, no alignment; their tests compare with brute force."""
    return {"op1_chat_format": OP1_SQL, "op3_base": OP3_BASE_SQL, "op4_secret_scan": OP4_SQL, "op6_ngram_join": OP6_SQL, "op12_vector_codes": OP12_SQL, "op13_structure_repair": OP13_SQL}
