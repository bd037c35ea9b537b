"""Lexicon ETL over a phrase table derived from `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import guards, lexicon as ops
from tidewell.plans.inputs import table
from tidewell.plans.registry import query
from tidewell.sources.lexicon import clean_words

_HEADS = ("i am", "cannot stop", "kill", "take", "going to", "do not", "i have", "hurt")
_SLOTS = ("states", "self_harm_actions", "reported_crisis_actions", "modifiers", "contexts", "violent_actions", "unlisted")
_CATEGORIES = ("everyday_stress", "major_stress", "crisis")


def _quoted(items):
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


_PHRASE = "CASE WHEN {k} % 17 = 0 THEN substr(p_name, 1, 3) WHEN {k} % 19 = 0 THEN 'kms' WHEN {k} % 23 = 0 THEN 'stab' ELSE {head} || ' ' || p_name END"


def phrases(spark, sf):
    pick = lambda items, i: f"element_at(array({_quoted(items)}), CAST({i} AS INT) + 1)"
    return table(spark, sf, "part").selectExpr(
        "p_partkey", "CAST(p_size % 3 + 1 AS INT) AS severity", f"{pick(_CATEGORIES, 'p_size % 3')} AS category",
        f"{pick(_SLOTS, 'p_partkey % 7')} AS slot",
        _PHRASE.format(k="p_partkey", head=pick(_HEADS, "p_partkey % 8")) + " AS phrase")


PHRASES = f"""phrases AS (SELECT p_partkey, CAST(p_size % 3 + 1 AS INT) AS severity, ([{_quoted(_CATEGORIES)}])[1 + p_size % 3] AS category,
  ([{_quoted(_SLOTS)}])[1 + p_partkey % 7] AS slot, {_PHRASE.format(k='p_partkey', head=f"([{_quoted(_HEADS)}])[1 + p_partkey % 8]")} AS phrase
  FROM part)"""
_SIGNAL = f"slot IN ({_quoted(guards.SIGNAL_SLOTS)})"
_SHORTS = "contractions(full_form, short_form) AS (VALUES " + ", ".join(
    f"({_quoted([full])}, {_quoted([short])})" for full, shorts in guards.CONTRACTIONS.items() for short in shorts) + ")"
_ING = "gerunds(verb, gerund) AS (VALUES " + ", ".join(f"('{v}', '{g}')" for v, g in guards.GERUNDS.items()) + ")"
_INFLECT = """forms AS (SELECT * FROM base UNION ALL SELECT b.* REPLACE (g.gerund || ' ' || substr(b.phrase, instr(b.phrase, ' ') + 1) AS phrase)
  FROM base b JOIN gerunds g ON split_part(b.phrase, ' ', 1) = g.verb WHERE instr(b.phrase, ' ') > 0
  AND substr(b.phrase, instr(b.phrase, ' ') + 1) != ''),
  variants AS (SELECT * FROM forms UNION ALL SELECT f.* REPLACE (replace(f.phrase, c.full_form, c.short_form) AS phrase)
  FROM forms f JOIN contractions c ON contains(f.phrase, c.full_form))"""


@query("signal_phrases", f"WITH {PHRASES} SELECT p_partkey, slot, phrase FROM phrases WHERE {_SIGNAL}")
def signal_phrases(spark, sf):
    return ops.signal_phrases(phrases(spark, sf)).select("p_partkey", "slot", "phrase")


@query("root_filter", f"""WITH {PHRASES} SELECT p_partkey, lower(trim(phrase)) AS phrase FROM phrases
  WHERE length(trim(phrase)) >= 4 OR lower(trim(phrase)) IN ('kms')""")
def root_filter(spark, sf):
    return ops.root_filter(phrases(spark, sf)).select("p_partkey", "phrase")


@query("contraction_variants", f"""WITH {PHRASES}, {_SHORTS} SELECT p_partkey, phrase, replace(phrase, full_form, short_form) AS variant
  FROM phrases JOIN contractions ON contains(phrase, full_form)""")
def contraction_variants(spark, sf):
    return ops.contraction_variants(phrases(spark, sf)).select("p_partkey", "phrase", "variant")


@query("gerund_variants", f"""WITH {PHRASES}, {_SHORTS}, {_ING}, base AS (SELECT p_partkey, phrase FROM phrases), {_INFLECT}
  SELECT p_partkey, phrase AS variant FROM variants""")
def gerund_variants(spark, sf):
    return ops.gerund_variants(phrases(spark, sf)).select("p_partkey", "variant")


@query("root_vocabulary", f"""WITH {PHRASES}, {_SHORTS}, {_ING}, base AS (SELECT severity, category, lower(trim(phrase)) AS phrase
  FROM phrases WHERE {_SIGNAL} AND (length(trim(phrase)) >= 4 OR lower(trim(phrase)) IN ('kms'))), {_INFLECT}
  SELECT DISTINCT severity, category, phrase FROM variants""")
def root_vocabulary(spark, sf):
    return ops.root_vocabulary(phrases(spark, sf))


_TARGETS = ("him", "that guy", "my boss")


@query("action_target_pairs", f"""WITH {PHRASES}, {_SHORTS}, {_ING}, base AS (SELECT severity, category, lower(phrase) AS phrase
  FROM phrases WHERE slot = 'violent_actions'), {_INFLECT}, actions AS (SELECT DISTINCT * FROM (SELECT * FROM variants UNION ALL
  SELECT b.severity, b.category, g.gerund FROM base b JOIN gerunds g ON b.phrase = g.verb))
  SELECT severity, category, phrase || ' ' || t.target AS phrase FROM actions, (VALUES {', '.join(f"('{t}')" for t in _TARGETS)}) t(target)""")
def action_target_pairs(spark, sf):
    return ops.action_target_pairs(phrases(spark, sf), _TARGETS)


@query("compile_alternation", f"""WITH {PHRASES} SELECT category, slot, count(*) AS phrases,
  string_agg(replace(phrase, ' ', '\\ '), '|' ORDER BY length(phrase) DESC, phrase) AS pattern
  FROM (SELECT DISTINCT category, slot, phrase FROM phrases) GROUP BY category, slot""")
def compile_alternation(spark, sf):
    return ops.compile_alternation(phrases(spark, sf))


def _slots(spark, sf):
    return phrases(spark, sf).select("category", "slot").distinct().select(
        F.concat(F.lit("t_"), "category").alias("template_id"), "category",
        F.array_position(F.array(*[F.lit(s) for s in _SLOTS]), F.col("slot")).cast("int").alias("pos"), "slot")


# The alternatives of each slot, longest first; a slot's place and whether it is optional decide where the white space goes.
_SPECIAL = r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])"
_ESCAPED = r"\\\1"
_TEMPLATE = rf"""{PHRASES}, words AS (SELECT category, slot, list_position([{_quoted(_SLOTS)}], slot) AS pos, slot IN ({_quoted(guards.REQUIRED_SLOTS)}) AS required,
    '(?:' || string_agg(regexp_replace(phrase, '{_SPECIAL}', '{_ESCAPED}', 'g'), '|' ORDER BY length(phrase) DESC, phrase) || ')' AS alternatives
    FROM (SELECT DISTINCT category, slot, phrase FROM phrases WHERE phrase IS NOT NULL) GROUP BY ALL),
  placed AS (SELECT *, max(pos) FILTER (required) OVER (PARTITION BY category) AS last_required, lag(required) OVER (PARTITION BY category ORDER BY pos) AS after FROM words),
  parts AS (SELECT *, CASE WHEN after THEN '\s+' ELSE '' END AS gap FROM placed)"""


@query("compile_template", rf"""WITH {_TEMPLATE} SELECT category, 't_' || category AS template_id, '(?<!\w)' || string_agg(CASE WHEN required THEN gap || alternatives
  WHEN pos < last_required THEN gap || '(?:' || alternatives || '\s+)?' ELSE '(?:\s+' || alternatives || ')?' END, '' ORDER BY pos) || '(?!\w)' AS regex FROM parts GROUP BY category""")
def compile_template(spark, sf):
    return ops.compile_template(_slots(spark, sf), phrases(spark, sf))


@query("combination_count", f"""WITH {PHRASES} SELECT 't_' || category AS template_id, CAST(product(CASE WHEN slot IN
  ({_quoted(guards.REQUIRED_SLOTS)}) THEN n ELSE n + 1 END) AS BIGINT) AS combinations FROM (SELECT category, slot,
  count(DISTINCT phrase) AS n FROM phrases GROUP BY ALL) GROUP BY category""")
def combination_count(spark, sf):
    return ops.combination_count(_slots(spark, sf), phrases(spark, sf)).drop("combinations_exact")


@query("lexicon_stats", f"""WITH {PHRASES} SELECT severity, category, kind, count(*) AS entries FROM (
  SELECT severity, category, 'rule' AS kind FROM (SELECT DISTINCT CAST(p_size % 3 + 1 AS INT) AS severity,
  ([{_quoted(_CATEGORIES)}])[1 + p_size % 3] AS category, p_brand FROM part)
  UNION ALL SELECT severity, category, slot FROM phrases) GROUP BY ALL""")
def lexicon_stats(spark, sf):
    listed = phrases(spark, sf)
    brands = table(spark, sf, "part").select("p_partkey", "p_brand")
    rules = listed.join(brands, "p_partkey").select("severity", "category", "p_brand").distinct().withColumn("kind", F.lit("rule"))
    return ops.lexicon_stats(rules, listed)


@query("dedupe_first", """SELECT lower(t.w) AS item, min(t.pos) AS first_pos FROM (SELECT unnest(string_split(text, ' ')) AS w,
  (conv_id * 1000 + turn) * 100000 + unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations) t GROUP BY 1""")
def dedupe_first(spark, sf):
    words = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    placed = words.withColumn("pos", (F.col("conv_id") * 1000 + F.col("turn")) * 100000 + F.col("i"))
    return ops.dedupe_first(placed, "w", "pos")


_STARTERS, _MODIFIERS = ("i am", "im", "feeling"), ("so", "really")


@query("expand_phrases", f"""WITH roots AS (SELECT DISTINCT p_name AS phrase FROM part)
  SELECT phrase, s || coalesce(' ' || m, '') || ' ' || phrase AS expanded FROM roots,
  (VALUES {', '.join(f"('{s}')" for s in _STARTERS)}) a(s), (VALUES (NULL), {', '.join(f"('{m}')" for m in _MODIFIERS)}) b(m)""")
def expand_phrases(spark, sf):
    roots = table(spark, sf, "part").select(F.col("p_name").alias("phrase")).distinct()
    return ops.expand_phrases(roots, _STARTERS, _MODIFIERS)


@query("cross_labels", """SELECT c_custkey, c_name || ' ' || v AS label FROM customer, (VALUES ('is'), ('said they are'), ('sounds')) t(v)""")
def cross_labels(spark, sf):
    named = table(spark, sf, "customer").select("c_custkey", "c_name")
    return ops.cross_labels(named, "c_name", ("is", "said they are", "sounds")).select("c_custkey", "label")


_REASON = "CASE WHEN p_partkey % 3 = 0 THEN 'because i lost ' || p_name ELSE 'because they took ' || p_name END"


@query("third_person", f"""WITH r AS (SELECT p_partkey, {_REASON} AS phrase FROM part) SELECT * FROM r UNION ALL
  SELECT p_partkey, replace(phrase, 'because i ', 'because they ') FROM r WHERE starts_with(phrase, 'because i ')""")
def third_person(spark, sf):
    return ops.third_person(table(spark, sf, "part").selectExpr("p_partkey", f"{_REASON} AS phrase"))


@query("read_words", r"""SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split_regex(text, '[ \t\n\r]+')) AS w FROM documents)
  WHERE regexp_full_match(w, '\p{L}+') AND length(w) >= 3""")
def read_words(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", r"[ \t\n\r]+")).alias("value"))
    return clean_words(lines, "value")
