"""Keyword level + model verdict + settings -> final level, surface, action, event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.levels import LEVELS, clamp, level_name, severity_rank
from tidewell.functions.sizing import lookup_join, not_broadcast_unmeasured

# What a missing or malformed verdict turns into.
FAIL_SAFE_LEVEL = "high"
FAIL_SAFE_CATEGORIES = ("distress",)

# The response to each level.
CRISIS_RESOURCES = (
    ("988 Suicide & Crisis Lifeline", "Call or text 988", "24/7"),
    ("Crisis Text Line", "Text HOME to 741741", "24/7"),
    ("School counselor", "[[PRE_SELECTED_SCHOOL_COUNSELOR_CONTACT]]", "School hours"),
)
RESPONSES = {
    "crisis": ("show_crisis_resources", True, True, False,
               "It sounds like you're in a lot of pain right now. "
               "Please reach out — help is available right now."),
    "high": ("show_crisis_resources_with_support_prompt", True, True, True,
             "You don't have to carry this alone. Want to loop in someone you trust?"),
    "moderate": ("gentle_nudge", False, False, True,
                 "That sounds heavy. It might help to talk to someone you trust."),
    "low": ("supportive_nudge", False, False, True, "Sounds like a high-strain day — want to take 5?"),
    "none": ("none", False, False, True, None),
}

# Labels shown when a verdict names no category.
CONTEXT_LABELS = {
    "none": "no concern", "low": "low", "moderate": "moderate concern",
    "high": "high concern", "crisis": "crisis",
}

# The coaching reply used when no model reply can be read.
COACH_FALLBACK = {
    "reply": "Hey, I'm really glad you told me. That sounds so heavy and "
             "you're not alone in it. Are you safe right now?",
    "guidance": "Lead by validating them and asking if they're safe. Stay "
                "calm — you don't have to fix it, just be there and keep them talking.",
    "danger": "watch",
    "escalation_reason": "",
}

EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"


def outermost_object(raw: Column) -> Column:
    """The text from the first opening to the last closing brace; null when there is none."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(body != "", body)


def parse_verdicts(verdicts: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `parsed_level` and struct `judgment`, both null where the output is missing, malformed or of
    no known level. The level is kept flat so that filters on it need not rebuild the struct."""
    staged = verdicts.withColumn("_v", F.try_parse_json(outermost_object(F.col(raw))))
    level = F.try_variant_get("_v", "$.risk_level", "string")
    staged = staged.withColumn("parsed_level", F.element_at(
        F.create_map(*[x for name in LEVELS for x in (F.lit(name), F.lit(name))]), level))
    listed = F.try_variant_get("_v", "$.categories", "array<string>")
    kind_of = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    as_double = F.when(kind_of("$.confidence") == "BOOLEAN", F.try_variant_get("_v", "$.confidence", "boolean").cast("double")) \
        .when(kind_of("$.confidence") != "STRING", F.try_variant_get("_v", "$.confidence", "double"))
    prose = F.when(kind_of("$.rationale") == "STRING", F.try_variant_get("_v", "$.rationale", "string"))
    judgment = F.struct(
        F.col("parsed_level").alias("risk_level"),
        F.coalesce(listed, F.array(F.lit("none"))).alias("categories"),
        clamp(F.coalesce(as_double, F.lit(0.0)), 0.0, 1.0).alias("confidence"),
        F.coalesce(prose, F.lit("")).alias("rationale"))
    return staged.withColumn("judgment", F.when(F.col("parsed_level").isNotNull(), judgment)).drop("_v")


def fail_safe(parsed: DataFrame, error: str = "error") -> DataFrame:
    """Fills missing, errored and invalid judgments so that they route to a person."""
    broken = F.col("parsed_level").isNull() | F.col(error).isNotNull()
    reason = F.when(F.col(error).isNotNull(), "Classifier call failed; failing safe to human review.").otherwise(
        "Classifier output was missing or unparseable; failing safe to human review.")
    safe = F.struct(
        F.lit(FAIL_SAFE_LEVEL).alias("risk_level"),
        F.array(*[F.lit(c) for c in FAIL_SAFE_CATEGORIES]).alias("categories"),
        F.lit(0.0).alias("confidence"), reason.alias("rationale"))
    return parsed.withColumns({
        "source": F.when(broken, "fail_safe").otherwise("model"),
        "model_level": F.when(broken, FAIL_SAFE_LEVEL).otherwise(F.col("parsed_level")),
        "judgment": F.when(broken, safe).otherwise(F.col("judgment"))}).drop("parsed_level")


def parse_coach(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds struct `coach`; unknown danger becomes `watch`, an unreadable reply the fallback."""
    staged = replies.withColumn("_v", F.try_parse_json(outermost_object(F.col(raw))))

    def field(name: str) -> Column:
        return F.trim(F.coalesce(F.try_variant_get("_v", f"$.{name}", "string"), F.lit("")))

    danger = F.try_variant_get("_v", "$.danger", "string")
    parsed = F.struct(
        field("reply").alias("reply"), field("guidance").alias("guidance"),
        F.when(danger.isin("none", "watch", "escalate"), danger).otherwise("watch").alias("danger"),
        field("escalation_reason").alias("escalation_reason"))
    fallback = F.struct(*[F.lit(v).alias(k) for k, v in COACH_FALLBACK.items()])
    readable = F.try_variant_get("_v", "$.reply", "variant").isNotNull()
    return staged.withColumn("coach", F.when(readable, parsed).otherwise(fallback)).drop("_v")


def decide_response(frame: DataFrame, level: str) -> DataFrame:
    """Adds struct `response`. The five responses are constants, an unknown level counts as high."""
    none = F.array().cast("array<struct<name:string,contact:string,available:string>>")
    resources = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(c).alias("contact"), F.lit(a).alias("available"))
        for n, c, a in CRISIS_RESOURCES])

    def response(name: str) -> Column:
        action, with_resources, human, dismissible, message = RESPONSES[name]
        return F.struct(
            F.lit(name).alias("risk_level"), F.lit(action).alias("action"),
            (resources if with_resources else none).alias("resources"),
            F.lit(human).alias("route_to_human"), F.lit(dismissible).alias("dismissible"),
            F.lit(message).cast("string").alias("message"))

    chosen = F.when(F.col(level) == "crisis", response("crisis"))
    for name in ("moderate", "low", "none"):
        chosen = chosen.when(F.col(level) == name, response(name))
    return frame.withColumn("response", chosen.otherwise(response("high")))


def surface(final: Column, policy: Column) -> Column:
    """urgent, gentle or none. `everything` also surfaces low levels."""
    return (F.when(final.isin("crisis", "high"), "urgent")
            .when((final == "moderate") | ((policy == "everything") & (final == "low")), "gentle")
            .otherwise("none"))


def final_rank(keyword: Column, model: Column, semantic_on: Column, failed: Column, threat: Column) -> Column:
    """Final level rank of messages no fast path decided.

    Model off: the keyword level. Model failed: the higher of keyword and fail-safe. Otherwise the
    model decides, may veto to none, and may not lower a keyword hit. A received threat is at least
    high unless the model said none.
    """
    chosen = F.when(~semantic_on, keyword).when(failed, F.greatest(keyword, model)).otherwise(model)
    floored = keyword_floor(chosen, keyword, model, semantic_on, failed)
    return threat_floor(floored, threat, semantic_on)


def keyword_floor(chosen: Column, keyword: Column, model: Column, semantic_on: Column, failed: Column) -> Column:
    return F.greatest(chosen, F.when(semantic_on & ~failed & (model > 0), keyword).otherwise(0))


def threat_floor(rank: Column, threat: Column, semantic_on: Column) -> Column:
    raised = F.when(threat & (rank > 0), 3).otherwise(0)
    return F.when(threat & ~semantic_on, 3).otherwise(F.greatest(rank, raised))


def attributed_layer(semantic_on: Column, failed: Column, matched: Column, keyword: Column, final: Column) -> Column:
    """1 when the keyword layer produced the final level, else 2."""
    return F.when(~semantic_on | failed, 1).when(matched & (keyword >= final), 1).otherwise(2)


def fuse_verdicts(scanned: DataFrame, verdicts: DataFrame, settings: DataFrame,
                  message_id: str = "msg_id", user: str = "user_id") -> DataFrame:
    """Final verdict per scanned message.

    Only messages that no fast path decides take part in the verdict join. Users without a settings
    row, and anonymous messages, get every layer on; anonymous messages record nothing. Settings and verdicts grow
    with the users and messages, so they are counted before a broadcast.
    """
    prefs = settings.select(user, F.col("toggles").alias("_toggles"), F.col("popup_policy").alias("_policy"))
    joined = lookup_join(scanned, prefs, [user], [message_id], measured=True)

    def toggle(name: str) -> Column:
        return F.coalesce(F.col("_toggles")[name], F.lit(True))

    keyword_on = toggle("keyword")
    staged = joined.select(
        *scanned.columns, keyword_on.alias("keyword_on"), toggle("semantic").alias("semantic_on"),
        F.coalesce("_policy", F.lit("balanced")).alias("policy"),
        F.when(keyword_on, F.col("level")).otherwise(0).alias("k_rank"),
        (keyword_on & F.col("tier3")).alias("k_tier3"),
        (keyword_on & F.col("matched")).alias("k_matched"),
        (keyword_on & F.col("received_threat")).alias("k_threat"),
        F.when(keyword_on, F.col("categories")).otherwise(F.array().cast("array<string>")).alias("k_categories"))
    route = (F.when(F.col("k_tier3"), "crisis_phrase")
             .when((F.col("policy") == "everything") & (F.col("k_rank") > 0), "everything")
             .otherwise("model"))
    staged = staged.withColumn("route", route)
    decided = staged.where(F.col("route") != "model").withColumns({
        "judgment": F.lit(None).cast("struct<risk_level:string,categories:array<string>,confidence:double,rationale:string>"),
        "source": F.lit("layer1"), "model_level": F.lit("none"), "failed": F.lit(False)})
    asked = fail_safe(parse_verdicts(
        staged.where(F.col("route") == "model").join(
            not_broadcast_unmeasured(verdicts.select(message_id, "raw", "error")), message_id, "left")))
    disabled = F.struct(
        F.lit("none").alias("risk_level"), F.array().cast("array<string>").alias("categories"),
        F.lit(0.0).alias("confidence"), F.lit("semantic layer disabled in settings").alias("rationale"))
    undecided = asked.withColumns({
        "judgment": F.when(F.col("semantic_on"), F.col("judgment")).otherwise(disabled),
        "model_level": F.when(F.col("semantic_on"), F.col("model_level")).otherwise("none"),
        "failed": F.col("semantic_on") & (F.col("source") == "fail_safe"),
        "source": F.when(F.col("semantic_on"), F.col("source")).otherwise("disabled"),
    }).drop("raw", "error")
    both = decided.unionByName(undecided)
    model_rank = severity_rank("model_level")
    rank = (F.when(F.col("route") == "crisis_phrase", 4)
            .when(F.col("route") == "everything", F.col("k_rank"))
            .otherwise(final_rank(F.col("k_rank"), model_rank, F.col("semantic_on"), F.col("failed"), F.col("k_threat"))))
    fast_categories = F.when((F.col("route") == "crisis_phrase") & (F.size("k_categories") == 0),
                             F.array(F.lit("crisis"))).otherwise(F.col("k_categories"))
    merged_categories = F.when(F.size("k_categories") > 0, F.col("k_categories")).otherwise(
        F.coalesce("judgment.categories", F.array().cast("array<string>")))
    ranked = both.withColumn("final_rank", rank.cast("int")).withColumns({
        "verdict_categories": F.when(F.col("route") == "model", merged_categories).otherwise(fast_categories),
        "confidence": F.when(F.col("route") == "crisis_phrase", 1.0).when(F.col("route") == "everything", 0.9)
        .otherwise(F.col("judgment.confidence")),
    })
    final = level_name("final_rank")
    default = F.when(F.col("route") == "everything", "unknown").otherwise("signal")
    layer = F.when(F.col("route") != "model", 1).otherwise(attributed_layer(
        F.col("semantic_on"), F.col("failed"), F.col("k_matched"), F.col("k_rank"), F.col("final_rank")))
    return decide_response(ranked.withColumns({
        "risk_level": final,
        "surface": F.when(F.col("route") == "everything",
                          F.when(F.col("k_rank") >= 3, "urgent").otherwise("gentle"))
        .otherwise(surface(final, F.col("policy"))),
        "event_layer": layer.cast("int"),
        "event_category": F.coalesce(F.get("verdict_categories", F.lit(0)), default),
        "recorded": F.col(user).isNotNull() & (F.col("final_rank") > 0),
    }), "risk_level")


def attribute_event(fused: DataFrame, user: str = "user_id", seq: str = "msg_id", ts: str = "ts") -> DataFrame:
    """History rows of the recorded verdicts: no text, one row per message."""
    return fused.where("recorded").select(
        F.col(user).alias("user_id"), F.col(seq).alias("seq"), F.col(ts).alias("ts"),
        F.col("event_layer").alias("layer"), F.col("risk_level").alias("level"),
        F.col("event_category").alias("category"))


def context_label(categories: Column, level: Column) -> Column:
    """The categories joined, else a label for the level."""
    label = level
    for name, text in CONTEXT_LABELS.items():
        label = F.when(level == name, text).otherwise(label)
    joined = F.array_join(categories, ", ")
    return F.when(joined != "", joined).otherwise(label)


def extract_email(contact: Column) -> Column:
    """First address in a contact string, empty when there is none."""
    return F.regexp_extract(F.coalesce(contact, F.lit("")), "(?U)" + EMAIL, 0)


def escalation_candidates(events: DataFrame, settings: DataFrame, sends: DataFrame, as_of: Column,
                          after: int = 3, hours: int = 24) -> DataFrame:
    """Users with at least `after` crises in the last day, nothing sent in it, and an address to send to."""
    since = as_of - F.expr(f"INTERVAL {hours} HOURS")
    counted = events.where((F.col("level") == "crisis") & (F.col("ts") >= since) & (F.col("ts") <= as_of)) \
        .groupBy("user_id").agg(F.count("*").alias("crises")).where(F.col("crises") >= after)
    recent = sends.where(F.col("ts") >= since).select("user_id").distinct()
    contacts = settings.select("user_id", extract_email(F.col("contact")).alias("address"))
    return (counted.join(recent, "user_id", "left_anti").join(contacts, "user_id")
            .where(F.col("address") != ""))


def escalation_events(outcomes: DataFrame) -> DataFrame:
    """History rows of attempted notes: sent counts as a crisis, prepared as moderate.

    Where a column `automatic` says that nobody asked for the note, one that was sent is an event of the keyword layer, and one that was not leaves none.
    """
    sent = F.col("sent")
    automatic = F.coalesce("automatic", F.lit(False)) if "automatic" in outcomes.columns else F.lit(False)
    return outcomes.where(~automatic | sent).select(
        "user_id", "ts", F.when(automatic, 1).when(sent, 4).otherwise(2).alias("layer"),
        F.when(sent, "crisis").otherwise("moderate").alias("level"),
        F.when(automatic, "auto_escalation").when(sent, "escalation_sent").otherwise("escalation_prepared").alias("category"))


def label_transcript(turns: DataFrame, conversation: str = "conv_id", order: str = "turn",
                     most_turns: int = 60, longest: int = 4000) -> DataFrame:
    """One labelled transcript per conversation within the caps; turns without a role are skipped.

    The caps bound what one row may gather.
    """
    allowed = conversation_caps(turns, conversation, most_turns, longest).where("accepted").select(conversation)
    friend = F.col("role") == "friend"
    said = F.struct(
        F.col(order).alias("turn"), F.when(friend, "user").otherwise("assistant").alias("role"),
        F.concat(F.when(friend, "[FRIEND] ").otherwise("[STUDENT (me)] "), F.coalesce("content", F.lit("")))
        .alias("content"))
    kept = turns.where(F.col("role").isNotNull()).join(allowed, conversation, "left_semi")
    return kept.groupBy(conversation).agg(F.array_sort(F.collect_list(said)).alias("transcript"))


def conversation_caps(turns: DataFrame, conversation: str = "conv_id", most_turns: int = 60,
                      longest: int = 4000) -> DataFrame:
    """Turn count and longest turn per conversation, and whether both stay within the caps."""
    return turns.groupBy(conversation).agg(
        F.count("*").alias("turns"), F.max(F.length("content")).alias("longest")).withColumn(
        "accepted", (F.col("turns") <= most_turns) & (F.coalesce("longest", F.lit(0)) <= longest))
