"""Text detection over `documents` and `conversations`, whole texts throughout."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from tidewell.functions.text import match_spans, no_spans, normalize_text
from tidewell.operators import fuzzy, guards, scan
from tidewell.plans.inputs import MESSAGES, bounded_sql, messages, norm_sql, table
from tidewell.plans.registry import query
from tidewell.sources.lexicon import shipped_lexicon


@cache
def _matchers(application: str, spark):
    return scan.load_matchers(shipped_lexicon(spark))


def matchers(spark):
    """Matchers of the shipped lexicon, loaded once per session."""
    return _matchers(spark.sparkContext.applicationId, spark)


# What the scan says of each sentence, by hand: (kind, level, hits). A "sure" finding stands whatever the text says; a misspelling or bare word ("fuzzy") falls
# where the text laughs, an "open" phrase where it laughs nearby or speaks of everyday things, a "threat" where it laughs nearby.
SAID = {
    "screw this test": ("sure", 1, [("screw this test", "everyday_stress")]),
    "i am really worn out because of school today": ("sure", 1, [("i am really worn out because of school today", "everyday_stress"), ("worn out", "everyday_stress")]),
    "im having a meltdown": ("sure", 2, [("having a meltdown", "major_stress"), ("im having a meltdown", "major_stress")]),
    "everything is falling apart": ("sure", 2, [("everything is falling apart", "major_stress"), ("falling apart", "major_stress")]),
    "i give up": ("open", 2, [("i give up", "major_stress")]),
    "lol i want to kill myself": ("sure", 4, [("i want to kill myself", "crisis"), ("kill myself", "crisis")]),
    "thinking of hurting myself": ("sure", 4, [("hurting myself", "crisis")]),
    "i want to kill that guy tonight": ("sure", 4, [("i want to kill that guy tonight", "crisis"), ("kill that guy", "crisis")]),
    "no reason to live": ("sure", 4, [("no reason to live", "crisis")]),
    "he said he will hurt me": ("sure", 4, [("he said he will hurt me", "crisis")]),
    "i want to kill you": ("threat", 3, [("i want to kill you", "received_threat")]),
    "you're worthless": ("threat", 3, [("you're worthless", "received_threat")]),
    "i feel so depresssed": ("fuzzy", 3, [("depressed", "fuzzy")]),
    "i am tierd": ("fuzzy", 1, [("tired", "fuzzy")]),
    "i am alone and empty": ("fuzzy", 3, [("alone", "fuzzy"), ("empty", "fuzzy")]),
}


def _q(items):
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def _pattern(text):
    return "'" + text.replace("'", "''") + "'"


_NORMED = f"{MESSAGES}, normed AS (SELECT msg_id, sentence, {norm_sql('text')} AS norm FROM messages)"


def normed(spark, sf):
    return messages(spark, sf).select("msg_id", "sentence", normalize_text("text").alias("norm"))


_LAUGH = (r"lo+l|lmf?a+o+|lma+o+|ro+fl|ha(?:ha)+h?|hehe+|ja(?:ja)+|so+\s+funny|hilarious|funniest|comedy|meme|jk|"
          r"jus+t?\s+kidding|joking|im\s+jokin[\p{L}\p{N}_]*|crying\s+laughing")
_SERIOUS = (r"suicid|kill\s+myself|killing\s+myself|unalive\s+myself|end\s+my\s+life|take\s+my\s+(?:own\s+)?life|self[\s-]?harm|"
            r"hurt\s+myself|cut\s+myself|don'?t\s+want\s+to\s+(?:be\s+alive|live|wake\s+up)|better\s+off\s+without\s+me|"
            r"no\s+reason\s+to\s+live")
_MUNDANE = guards.MUNDANE[len(r"(?U)\b(?:"):-len(r")\b")]


def laughs_sql(text: str) -> str:
    return f"(regexp_matches({text}, {_pattern(bounded_sql(_LAUGH))}) OR regexp_matches({text}, '😂|🤣|😹|💀'))"


def serious_sql(text: str) -> str:
    return f"(regexp_matches({text}, {_pattern(_SERIOUS)}) OR regexp_matches({text}, {_pattern(bounded_sql('kms'))}))"


def _said_rows() -> str:
    return ", ".join(f"({_pattern(t)}, '{kind}', {level}, [{', '.join(f'[{_pattern(p)}, {_pattern(c)}]' for p, c in hits)}])" for t, (kind, level, hits) in SAID.items())


# scanned: msg_id, user_id, ts, level, tier3, hits ([phrase, category] each), joking, threat
SCANNED = f"""{MESSAGES}, said(sentence, kind, lvl, found) AS (VALUES {_said_rows()}),
  heard AS (SELECT m.*, {norm_sql('text')} AS norm FROM messages m),
  flagged AS (SELECT h.*, kind, lvl, found, {laughs_sql('norm')} AS laughs, {serious_sql('norm')} AS serious,
    {laughs_sql(f'right(norm, length(sentence) + {guards.JOKE_RADIUS})')} AS close, regexp_matches(norm, {_pattern(bounded_sql(_MUNDANE))}) AS mundane
    FROM heard h LEFT JOIN said USING (sentence)),
  judged AS (SELECT *, kind IS NOT NULL AND NOT coalesce((kind = 'fuzzy' AND laughs AND NOT serious) OR (kind = 'open' AND (close OR mundane) AND NOT serious)
    OR (kind = 'threat' AND close), false) AS stays FROM flagged),
  scanned AS (SELECT msg_id, user_id, ts, sentence, CASE WHEN stays THEN lvl ELSE 0 END AS level, stays AND lvl = 4 AS tier3, CASE WHEN stays THEN found ELSE [] END AS hits,
    laughs AND NOT serious AS joking, stays AND kind = 'threat' AS threat FROM judged)"""
_LEVEL_NAME = "(['none', 'low', 'moderate', 'high', 'crisis'])[level + 1]"
# Categories of phrases and threats; a misspelling names none.
_CATEGORIES = "list_distinct(list_filter(list_transform(hits, lambda h: h[2]), lambda c: c <> 'fuzzy'))"


@query("normalize_text", f"SELECT doc_id, md5({norm_sql('text')}) AS digest, length({norm_sql('text')}) AS chars FROM documents")
def normalize(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", normalize_text("text").alias("norm"))
    return docs.select("doc_id", F.md5("norm").alias("digest"), F.length("norm").alias("chars"))


_WORD = "(the|of|und|la)"


@query("match_spans", f"""WITH d AS (SELECT doc_id, {norm_sql('text')} AS norm FROM documents),
  p AS (SELECT doc_id, unnest(regexp_extract_all(norm, '{_WORD}')) AS t,
    unnest((string_split_regex(norm, '{_WORD}'))[1:len(regexp_extract_all(norm, '{_WORD}'))]) AS pre,
    unnest(range(len(regexp_extract_all(norm, '{_WORD}')))) AS i FROM d),
  o AS (SELECT *, sum(length(pre) + length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p)
  SELECT doc_id, count(*) AS spans, sum(e - length(t)) AS starts, sum(e) AS ends, max(e) AS last FROM o GROUP BY doc_id""")
def spans(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", normalize_text("text").alias("norm"))
    found = docs.select("doc_id", F.explode(match_spans(F.col("norm"), _WORD)).alias("m"))
    return found.groupBy("doc_id").agg(
        F.count("*").alias("spans"), F.sum("m.s").alias("starts"), F.sum("m.e").alias("ends"), F.max("m.e").alias("last"))


@query("tokens", f"""WITH {_NORMED}, p AS (SELECT msg_id, unnest(regexp_extract_all(norm, '[a-z'']+')) AS token,
    unnest((string_split_regex(norm, '[a-z'']+'))[1:len(regexp_extract_all(norm, '[a-z'']+'))]) AS pre,
    unnest(range(len(regexp_extract_all(norm, '[a-z'']+')))) AS i FROM normed),
  o AS (SELECT *, sum(length(pre) + length(token)) OVER (PARTITION BY msg_id ORDER BY i) AS e FROM p)
  SELECT msg_id, token, CAST(e - length(token) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM o WHERE length(token) >= 3""")
def tokens(spark, sf):
    return fuzzy.tokens(normed(spark, sf), "msg_id", F.col("norm"))


@query("laugh_spans", f"""WITH {_NORMED} SELECT msg_id, regexp_matches(norm, {_pattern(bounded_sql(_LAUGH))})
  OR regexp_matches(norm, '😂|🤣|😹|💀') AS joking FROM normed""")
def laugh_spans(spark, sf):
    return normed(spark, sf).select("msg_id", (F.size(scan.laugh_spans(F.col("norm"))) > 0).alias("joking"))


@query("always_serious", f"""WITH {_NORMED} SELECT msg_id, regexp_matches(norm, {_pattern(_SERIOUS)})
  OR regexp_matches(norm, {_pattern(bounded_sql('kms'))}) AS serious FROM normed""")
def always_serious(spark, sf):
    return normed(spark, sf).select("msg_id", scan.always_serious(F.col("norm")).alias("serious"))


@query("mundane", f"""WITH {_NORMED} SELECT msg_id, regexp_matches(norm, {_pattern(bounded_sql(_MUNDANE))}) AS mundane FROM normed""")
def mundane(spark, sf):
    return normed(spark, sf).select("msg_id", scan.mundane(F.col("norm")).alias("mundane"))


def _discarding(spark):
    """The patterns by which the crisis level discards a text."""
    return [p for m in matchers(spark) if m.bypass for p in m.negative]


_NEGATIVE = r"(?:suicide\s+prevention|suicide\s+squad|crisis\s+hotline)|(?:kill|end)\s+(?:the\s+)?(?:process|task|app|meeting)"


@query("level_guard", f"""WITH {_NORMED} SELECT msg_id, regexp_matches(norm, {_pattern(bounded_sql(_NEGATIVE))}) AND NOT {serious_sql('norm')} AS discarded FROM normed""")
def level_guard(spark, sf):
    norm = F.col("norm")
    found = F.lit(False)
    for pattern in _discarding(spark):
        found = found | norm.rlike(pattern)
    return normed(spark, sf).select("msg_id", (found & ~scan.always_serious(norm)).alias("discarded"))


@query("received_threat", f"""WITH {SCANNED} SELECT msg_id, CASE WHEN kind = 'threat' THEN sentence END AS phrase, coalesce(kind = 'threat' AND stays, false) AS threat FROM judged""")
def received_threat(spark, sf):
    norm = F.col("norm")
    found = normed(spark, sf).select("msg_id", scan.first_threat(norm).alias("t"), scan.laugh_spans(norm).alias("laugh"))
    from tidewell.functions.text import near
    return found.select("msg_id", F.col("t.t").alias("phrase"), F.coalesce(
        F.col("t").isNotNull() & ~near(F.col("t.s"), F.col("t.e"), F.col("laugh"), guards.JOKE_RADIUS), F.lit(False)).alias("threat"))


@query("near", f"""WITH {_NORMED}, hit AS (SELECT msg_id, norm, length(norm) - length(sentence) AS s FROM normed),
  m AS (SELECT msg_id, s, norm, unnest(regexp_extract_all(norm, 'er')) AS t,
    unnest((string_split(norm, 'er'))[1:len(regexp_extract_all(norm, 'er'))]) AS pre,
    unnest(range(len(regexp_extract_all(norm, 'er')))) AS i FROM hit),
  o AS (SELECT *, sum(length(pre) + 2) OVER (PARTITION BY msg_id ORDER BY i) AS e FROM m),
  n AS (SELECT msg_id, bool_or(e - 2 <= length(norm) + 60 AND e >= s - 60) AS near FROM o GROUP BY msg_id)
  SELECT h.msg_id, coalesce(n.near, false) AS near FROM hit h LEFT JOIN n USING (msg_id)""")
def near_marker(spark, sf):
    from tidewell.functions.text import near
    norm = F.col("norm")
    start = F.length(norm) - F.length("sentence")
    return normed(spark, sf).select("msg_id", near(start, F.length(norm), match_spans(norm, "er"), 60).alias("near"))


_VERB = r"^(kill[\p{L}\p{N}_]*|die|dying|dead|cut|cutting|hopeless|empty|suicide)$"
_IDIOMS = ("my phone is dead", "i cut myself a slice of pizza", "bro im dying laughing lmao", "suicide squad was mid")


@query("drop_benign", f"""WITH {_NORMED}, n AS (SELECT msg_id, len(list_filter(regexp_extract_all(norm, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, {_pattern(_VERB)}))) AS verbs,
  CASE WHEN sentence IN ({_q(_IDIOMS)}) THEN 1 ELSE 0 END AS dropped FROM normed) SELECT msg_id, verbs - dropped AS kept, dropped FROM n""")
def drop_benign(spark, sf):
    """Verb hits kept after the idiom test: (message, kept, dropped)."""
    from tidewell.functions.text import inside_any
    norm = F.col("norm")
    verbs = match_spans(norm, r"(?U)\b(?:kill\w*|die|dying|dead|cut|cutting|hopeless|empty|suicide)\b")
    staged = normed(spark, sf).select("msg_id", verbs.alias("h"), scan.benign_spans(norm).alias("b"))
    kept = F.filter("h", lambda h: ~inside_any(h["s"], h["e"], F.col("b")))
    return staged.select("msg_id", F.size(kept).alias("kept"), (F.size("h") - F.size(kept)).alias("dropped"))


@query("drop_hyperbole", f"""WITH {_NORMED}, hit AS (SELECT msg_id, norm, sentence FROM normed)
  SELECT msg_id, sentence IN ('i want to die lol') AND regexp_matches(norm, {_pattern(bounded_sql(_LAUGH))}) AND NOT
  regexp_matches(norm, {_pattern(_SERIOUS)}) AS dropped FROM hit""")
def drop_hyperbole(spark, sf):
    """Exaggerations next to a laugh: the sentence `i want to die lol` holds one of each."""
    norm = F.col("norm")
    staged = normed(spark, sf).select(
        "msg_id", "norm", match_spans(norm, r"(?U)\bi want to die\b").alias("h"), scan.laugh_spans(norm).alias("l"),
        scan.always_serious(norm).alias("serious"))
    dropped = F.exists("h", lambda h: ~scan.keep_hit(h, norm, no_spans(), F.col("l"), F.col("serious"), F.lit(False)))
    return staged.select("msg_id", dropped.alias("dropped"))


@query("drop_ambiguous", f"""WITH {_NORMED}, roots AS (SELECT unnest([{_q(guards.AMBIGUOUS_ROOTS)}]) AS r),
  a AS (SELECT DISTINCT sentence FROM normed JOIN roots ON contains(sentence, r) OR contains(r, sentence))
  SELECT msg_id, sentence IN (SELECT sentence FROM a) AND regexp_matches(norm, {_pattern(bounded_sql(_MUNDANE))}) AS dropped FROM normed""")
def drop_ambiguous(spark, sf):
    norm = F.col("norm")
    end = F.length(norm)
    hit = F.struct((end - F.length("sentence")).alias("s"), end.alias("e"), F.col("sentence").alias("t"))
    return normed(spark, sf).select(
        "msg_id", (~scan.keep_hit(hit, norm, no_spans(), no_spans(), F.lit(False), scan.mundane(norm))).alias("dropped"))


_COMPLETION = guards.INNOCENT_COMPLETION[len("(?U)"):]


@query("innocent_completion", f"""WITH {_NORMED} SELECT msg_id, CASE WHEN contains(norm, ' want it to stop') THEN regexp_matches(
  substr(norm, instr(norm, ' want it to stop') + 16), {_pattern(_COMPLETION)}) ELSE
  regexp_matches(norm, {_pattern(_COMPLETION)}) END AS innocent FROM normed""")
def innocent_completion(spark, sf):
    norm = F.col("norm")
    at = F.instr(norm, " want it to stop")
    return normed(spark, sf).select(
        "msg_id", scan.innocent_completion(norm, F.when(at > 0, at + 15).otherwise(0)).alias("innocent"))


def _vocabulary(spark):
    """Literal phrases of the shipped lexicon, with the level they belong to."""
    rows = [(p, m.category, kind) for m in matchers(spark)
            for kind, words in (("exact", m.exact), ("roots", m.roots),
                                ("pairs", [f"{a} {t}" for a in m.actions for t in m.targets])) for p in words]
    return spark.createDataFrame(rows, "phrase string, category string, kind string")


_EXACT = {
    "screw this test": "everyday_stress", "this class is stressing me out": "everyday_stress",
    "i am so done for the final": "everyday_stress", "i give up": "major_stress",
    "everything is falling apart": "major_stress", "nobody cares about me": "major_stress", "i hate my life": "major_stress",
    "no one would notice": "major_stress", "i wish i was dead": "crisis", "no reason to live": "crisis",
    "everyone would be better off without me": "crisis", "i want to disappear": "crisis",
}


def _hits_sql(table_of):
    values = ", ".join("('" + p.replace("'", "''") + f"', '{c}')" for p, c in table_of.items())
    return f"""WITH {_NORMED}, v(phrase, category) AS (VALUES {values}),
  padded AS (SELECT msg_id, ' ' || trim(regexp_replace(norm, '[^\\p{{L}}\\p{{N}}_'']+', ' ', 'g')) || ' ' AS words FROM normed)
  SELECT DISTINCT msg_id, phrase, category FROM padded JOIN v ON contains(words, ' ' || phrase || ' ')"""


def _hits(spark, sf, kind):
    vocabulary = _vocabulary(spark).where(F.col("kind") == kind)
    return scan.phrase_hits(messages(spark, sf), vocabulary, "msg_id")


@query("exact_hits", _hits_sql(_EXACT))
def exact_hits(spark, sf):
    return _hits(spark, sf, "exact")


_ROOTS = {
    **{p: "everyday_stress" for p in ("stressed out", "worn out", "tired from studying", "swamped with work", "behind on deadlines",
                                      "buried in homework", "having a rough day", "running low on energy")},
    **{p: "major_stress" for p in ("overwhelmed by everything", "at my breaking point", "having a breakdown", "having a meltdown",
                                   "barely holding it together", "unable to cope", "can''t cope".replace("''", "'"), "cant cope",
                                   "cannot cope", "falling apart", "give up on everything", "giving up on everything",
                                   "unable to do this anymore", "can't do this anymore", "cant do this anymore", "cannot do this anymore")},
    **{p: "crisis" for p in ("kill myself", "killing myself", "hurt myself", "hurting myself", "end my life", "ending my life",
                             "take my own life", "taking my own life", "commit suicide", "committing suicide", "kms", "want to die",
                             "wanna die", "not be alive anymore", "kill himself", "killing himself", "kill herself", "killing herself",
                             "kill themselves", "killing themselves", "hurt themselves", "hurting themselves")},
}


@query("root_hits", _hits_sql(_ROOTS))
def root_hits(spark, sf):
    return _hits(spark, sf, "roots")


_PAIRS = {f"{a} {t}": "crisis" for a in ("kill", "killing", "hurt", "hurting", "attack", "attacking", "stab", "stabbing", "beat up", "beating up")
          for t in ("him", "her", "them", "that guy", "my teacher", "my boss")}


@query("pair_hits", _hits_sql(_PAIRS))
def pair_hits(spark, sf):
    return _hits(spark, sf, "pairs")


# Sentences for the rules, with what they match.
RULED = {
    "i'm so fried for the finals already": ("i'm so fried for the finals", "everyday_stress"), "im swamped with homework": ("im swamped with homework", "everyday_stress"),
    "i cannot take this anymore": ("i cannot take this anymore", "major_stress"), "we can't handle it anymore": None,
    "honestly i can't do it anymore, bye": ("i can't do it anymore", "major_stress"), "i am not fried": None,
}


@query("rule_hits", f"""WITH {MESSAGES}, rules(i, phrase, category) AS (VALUES {', '.join(f"({i}, {_pattern(m[0])}, '{m[1]}')" for i, m in enumerate(RULED.values()) if m)})
  SELECT msg_id, phrase, category FROM messages JOIN rules ON msg_id % {len(RULED)} = i""")
def rule_hits(spark, sf):
    ruled = F.element_at(F.array(*[F.lit(t) for t in RULED]), (F.col("msg_id") % len(RULED) + 1).cast("int"))
    texts = messages(spark, sf).select("msg_id", normalize_text(F.concat("text", F.lit(". "), ruled)).alias("norm"))
    return _pattern_hits(spark, texts, "rules")


_TEMPLATED = ("i am really worn out because of school today", "im having a meltdown", "lol i want to kill myself", "i want to kill that guy tonight", "he said he will hurt me")


@query("template_hits", f"""WITH {SCANNED} SELECT msg_id, found[1][1] AS phrase, found[1][2] AS category FROM judged
  WHERE sentence IN ({_q(t for t in _TEMPLATED if t != 'im having a meltdown')}) UNION ALL SELECT msg_id, sentence, 'major_stress' FROM judged WHERE sentence = 'im having a meltdown'""")
def template_hits(spark, sf):
    return _pattern_hits(spark, normed(spark, sf), "templates")


def _pattern_hits(spark, texts, kind):
    norm = F.col("norm")

    def hits(pattern, category):
        return F.transform(match_spans(norm, pattern), lambda h: F.struct(
            h["t"].alias("phrase"), F.lit(category).alias("category")))

    found = F.flatten(F.array(*[hits(p, m.category) for m in matchers(spark) for p in getattr(m, kind)]))
    return texts.select("msg_id", F.explode(F.array_distinct(found)).alias("h")).select("msg_id", "h.*")


_DISTINCT_TOKENS = f"toks AS (SELECT DISTINCT unnest(regexp_extract_all(norm, '[a-z'']+')) AS token FROM normed)"


def _distinct_tokens(spark, sf):
    return fuzzy.tokens(normed(spark, sf), "msg_id", F.col("norm"), shortest=1, places=False).select("token").distinct()


@query("collapse_repeats", f"""WITH {_NORMED}, {_DISTINCT_TOKENS} SELECT token, array_to_string(list_filter(string_split(token, ''),
  lambda c, i: i = 1 OR c != string_split(token, '')[i - 1]), '') AS collapsed FROM toks""")
def collapse_repeats(spark, sf):
    return _distinct_tokens(spark, sf).select("token", fuzzy.collapse_repeats(F.col("token")).alias("collapsed"))


_WORDS = f"words(word) AS (SELECT unnest([{_q(guards.FUZZY_WORDS)}]))"


@query("within_one_edit", f"""WITH {_NORMED}, {_DISTINCT_TOKENS}, {_WORDS} SELECT token, word FROM toks JOIN words
  ON abs(length(token) - length(word)) <= 1 AND damerau_levenshtein(token, word) <= 1""")
def within_one_edit(spark, sf):
    return fuzzy.within_one_edit(_distinct_tokens(spark, sf), "token", guards.FUZZY_WORDS).select("token", "word")


_DICTIONARY = "dictionary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents)"


@query("drop_real_words", f"""WITH {_NORMED}, {_DISTINCT_TOKENS}, {_DICTIONARY} SELECT token FROM toks WHERE token IN
  ({_q(guards.FUZZY_WORDS)}) OR (token NOT IN (SELECT word FROM dictionary) AND token NOT IN ({_q(guards.STOP_WORDS)}))""")
def drop_real_words(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    listed = fuzzy.tokens(docs, "doc_id", F.col("t"), shortest=1, places=False).select(F.col("token").alias("word"))
    stops = spark.createDataFrame([(w,) for w in guards.STOP_WORDS], "word string")
    return fuzzy.drop_real_words(_distinct_tokens(spark, sf), "token", listed.unionByName(stops))


_MARKERS = r"i|i'?m|me|myself|ive|i'?ve|feel[\p{L}\p{N}_]*|been|am|i'?d"


@query("attributed", f"""WITH {_NORMED}, p AS (SELECT msg_id, norm, unnest(regexp_extract_all(norm, '[a-z'']+')) AS token,
    unnest((string_split_regex(norm, '[a-z'']+'))[1:len(regexp_extract_all(norm, '[a-z'']+'))]) AS pre,
    unnest(range(len(regexp_extract_all(norm, '[a-z'']+')))) AS i FROM normed),
  o AS (SELECT *, CAST(sum(length(pre) + length(token)) OVER (PARTITION BY msg_id ORDER BY i) - length(token) AS BIGINT) AS s FROM p)
  SELECT msg_id, token, s AS start, CASE WHEN s <= 40 THEN regexp_matches(substr(norm, 1, s), {_pattern(bounded_sql(_MARKERS))})
  ELSE regexp_matches(substr(norm, s - 40, 41), {_pattern(bounded_sql(_MARKERS).replace('(^|', '(', 1))}) END AS own
  FROM o WHERE length(token) >= 3""")
def attributed(spark, sf):
    norm = F.col("norm")
    staged = normed(spark, sf).select(
        "msg_id", match_spans(norm, fuzzy.TOKEN).alias("t"), match_spans(norm, guards.SELF_ATTRIBUTION).alias("m"))
    judged = F.transform(F.filter("t", lambda t: F.length(t["t"]) >= 3), lambda t: F.struct(
        t["t"].alias("token"), t["s"].cast("long").alias("start"), fuzzy.attributed(t["s"], F.col("m")).alias("own")))
    return staged.select("msg_id", F.explode(judged).alias("j")).select("msg_id", "j.*")


_FUZZY_LEVELS = ", ".join(f"('{w}', {n})" for w, n in guards.FUZZY_WORDS.items())


@query("fuzzy_hits", f"""WITH {SCANNED}, core(word, level) AS (VALUES {_FUZZY_LEVELS}), h AS (SELECT msg_id, unnest(found) AS hit FROM judged WHERE kind = 'fuzzy')
  SELECT msg_id, word, level FROM h JOIN core ON hit[1] = word""")
def fuzzy_hits(spark, sf):
    norm = F.col("norm")
    found = normed(spark, sf).where(fuzzy.may_misspell(norm)).select(
        "msg_id", F.explode(fuzzy.found_words(fuzzy.spelt_words(norm), scan.benign_spans(norm))).alias("w"))
    return found.select("msg_id", "w.word", "w.level")


@query("roll_up_level", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 4 ELSE greatest(event_id % 3, event_id % 4,
  CASE WHEN event_type = 'error' THEN 3 ELSE 0 END) END AS level FROM events""")
def roll_up_level(spark, sf):
    key = F.col("event_id")
    return table(spark, sf, "events").select("event_id", scan.roll_up_level(
        key % 7 == 0, key % 3, key % 4, F.col("event_type") == "error").alias("level"))


@query("assemble_hits", f"""WITH {SCANNED}, h AS (SELECT msg_id, tier3, unnest(hits) AS hit FROM scanned)
  SELECT msg_id, hit[1] AS phrase, hit[2] AS category, CASE WHEN tier3 OR hit[2] = 'received_threat' THEN '3' ELSE '1' END AS tier FROM h""")
def assemble_hits(spark, sf):
    return scan.hit_rows(scan.scan_messages(messages(spark, sf), matchers(spark)), "msg_id")


def _scanned(df, *keys):
    return df.select(*keys, "level", "level_name", "tier3", "matched", F.array_join("categories", ",").alias("categories"),
                     F.size("hits").alias("hits"), "joking_context", "received_threat")


@query("scan_messages", f"""WITH {SCANNED} SELECT msg_id, user_id, level, {_LEVEL_NAME} AS level_name, tier3, len(hits) > 0 AS matched, array_to_string({_CATEGORIES}, ',') AS categories,
  len(hits) AS hits, joking AS joking_context, threat AS received_threat FROM scanned""")
def scan_messages(spark, sf):
    return _scanned(scan.scan_messages(messages(spark, sf), matchers(spark)), "msg_id", "user_id")


# The invented prose says nothing; only its syllables may laugh.
@query("scan_documents", f"""WITH d AS (SELECT doc_id, {norm_sql('text')} AS norm FROM documents) SELECT doc_id, 0 AS level, 'none' AS level_name, false AS tier3, false AS matched,
  '' AS categories, 0 AS hits, {laughs_sql('norm')} AND NOT {serious_sql('norm')} AS joking_context, false AS received_threat FROM d""")
def scan_documents(spark, sf):
    return _scanned(scan.scan_messages(table(spark, sf, "documents"), matchers(spark)), "doc_id")
