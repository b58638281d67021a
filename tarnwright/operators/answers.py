"""Answers over evidence packs: citations, validation, the deterministic composer, JSON schemas for answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases no answer may use (our own list).
BANNED = ("guarantee", "will not flood", "is safe", "is legal", "approved", "certified")
PLACEHOLDER, CITATION = r"\{\{[a-zA-Z0-9_.]+\}\}", r"\[[^\]]*\]"
#: Schema keywords that providers of structured answers understand.
KEYWORDS = ("type", "properties", "items", "enum", "required", "description", "additionalProperties")


def unknown_citations(cited: Column, pack: Column) -> Column:
    return F.array_except(cited, pack)


def bare_digit(text: Column) -> Column:
    """Whether a digit is left once placeholders and bracketed citations are gone."""
    return F.regexp_replace(F.regexp_replace(text, PLACEHOLDER, ""), CITATION, "").rlike("[0-9]")


def validate(answers: DataFrame) -> DataFrame:
    """answers (text, verdict, screened, cited, pack, intent, refused) with the list of faults, empty if valid."""
    c = F.col
    checks = {
        "bare digit": bare_digit(c("text")),
        "wrong verdict": ~c("verdict").eqNullSafe(c("screened")),
        "unknown citation": F.size(unknown_citations(c("cited"), c("pack"))) > 0,
        "no refusal": (c("intent") == "flood") & (F.size("refused") == 0),
        "banned phrase": F.lower("text").rlike("|".join(BANNED)),
    }
    faults = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items())))
    return answers.withColumn("faults", faults)


def compose(sites: DataFrame) -> DataFrame:
    """The text that is shown before, and without, any model: sites (verdict, ruleId, distPresent, uncertaintyM, chunks)."""
    distance = F.when(F.col("distPresent") < 255, F.format_string("%d m from water", "distPresent")).otherwise("farther from water than is measured")
    text = F.concat_ws(" ", F.format_string("Outcome %s under the %s rule:", "verdict", "ruleId"), F.concat(distance, F.format_string(", plus or minus %d m.", "uncertaintyM")), F.concat(F.lit("Sources: "), F.array_join("chunks", ", "), F.lit(".")))
    return sites.withColumn("text", text)


def accepted_text(answers: DataFrame, tier0: str = "tier0") -> DataFrame:
    """The model's text if it has no fault, else the composed one with the reason."""
    ok = F.size("faults") == 0
    return answers.withColumns({"shown": F.when(ok, F.col("text")).otherwise(F.col(tier0)), "reason": F.when(~ok, F.array_join("faults", "; "))})


def prompt(packs: DataFrame) -> DataFrame:
    """packs (question, site, facts, chunks: array of id, body, verify) with one prompt text; unverified chunks are marked."""
    lines = F.transform("chunks", lambda c: F.concat(F.lit("["), c["id"], F.lit("] "), F.when(c["verify"], "(unverified) ").otherwise(""), c["body"]))
    return packs.withColumn("prompt", F.concat_ws("\n", F.concat(F.lit("Question: "), "question"), F.concat(F.lit("Site: "), F.to_json("site")), F.concat(F.lit("Facts: "), F.to_json("facts")), F.array_join(lines, "\n")))


def reduced(schema: object) -> object:
    """A JSON schema with the understood keywords only."""
    if isinstance(schema, list):
        return [reduced(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {}
    for k, v in schema.items():
        if k == "properties":
            out[k] = {name: reduced(s) for name, s in v.items()}
        elif k in KEYWORDS:
            out[k] = reduced(v)
    return out


def tightened(schema: dict) -> dict:
    """All properties required, none beyond them."""
    out = {k: tightened(v) if isinstance(v, dict) and k == "items" else v for k, v in schema.items()}
    if "properties" in out:
        out["properties"] = {k: tightened(v) for k, v in out["properties"].items()}
        out |= {"required": list(out["properties"]), "additionalProperties": False}
    return out


def pinned(schema: dict, ids: list[str], fields: tuple[str, ...] = ("cited",)) -> dict:
    """Citation fields may hold the pack's ids only; left open for an empty pack."""
    if not ids:
        return schema
    out = dict(schema)
    out["properties"] = {k: v | {"items": v.get("items", {}) | {"enum": sorted(ids)}} if k in fields else v for k, v in schema.get("properties", {}).items()}
    return out


#: The largest request that is read, and what it must have.
MOST_BYTES, REQUEST_KEYS = 1 << 20, ("pack", "contract", "tool")


def request_status(requests: DataFrame) -> DataFrame:
    """requests (path, body, configured) with the status they are answered with and the reason; the first fault decides.

    Without a model configured the state is 503, which is no failure: the composed answer stands.
    """
    body = F.col("body")
    size = F.coalesce(F.octet_length(body), F.lit(0))
    faults = [(F.col("path") != "/ask", 404, F.lit("no such path")), (~F.col("configured"), 503, F.lit("no model is configured")), (~size.between(1, MOST_BYTES), 400, F.lit("bad request size")), (F.try_parse_json(body).isNull(), 400, F.lit("unreadable request"))]
    faults += [(F.get_json_object(body, f"$.{k}").isNull() & ~F.array_contains(F.coalesce(F.json_object_keys(F.when(F.try_parse_json(body).isNotNull(), body)), F.array().cast("array<string>")), k), 400, F.lit(f"missing {k}")) for k in REQUEST_KEYS]
    status, reason = F.lit(200), F.lit(None).cast("string")
    for bad, code, why in reversed(faults):
        bad = F.coalesce(bad, F.lit(True))
        status, reason = F.when(bad, code).otherwise(status), F.when(bad, why).otherwise(reason)
    return requests.withColumns({"status": status, "reason": reason})


def provider_message(detail: Column) -> Column:
    """The sentence in a provider's error, or what came in its place: something that is no JSON was said by another on the way."""
    flat = F.trim(F.regexp_replace(detail, r"\s+", " "))
    stranger = F.when(flat == "", "no detail").otherwise(F.concat(F.lit("blocked before it reached the provider ("), F.substring(flat, 1, 120), F.lit(")")))
    told = F.coalesce(*(F.get_json_object(detail, p) for p in ("$.error.message", "$.error.status", "$.error")), F.trim(detail))
    return F.when(F.try_parse_json(detail).isNull(), stranger).otherwise(told)


def structured(body: Column) -> Column:
    """answer (JSON text) and reason of a model's reply, in any of three shapes: choices, candidates, or content blocks.

    One of the two is null: a reply without a structured answer says what came instead.
    """
    get = lambda p: F.get_json_object(body, p)
    readable = lambda t: F.try_parse_json(t).isNotNull()
    told = lambda answer, reason: F.struct(answer.alias("answer"), reason.alias("reason"))
    none = F.lit(None).cast("string")

    text, stop = get("$.choices[0].message.content"), F.coalesce(get("$.choices[0].finish_reason"), F.lit("unknown"))
    cut = F.when(stop == "length", "the reply was cut off").otherwise("the reply is no JSON")
    chosen = F.when(get("$.choices[0]").isNull(), told(none, F.lit("no choices"))).when(F.coalesce(text, F.lit("")) == "", told(none, F.concat(F.lit("no content, ended by "), stop))).when(readable(text), told(text, none)).otherwise(told(none, cut))

    part, ended = get("$.candidates[0].content.parts[0].text"), F.coalesce(get("$.candidates[0].finishReason"), F.lit("unknown"))
    blocked = F.coalesce(F.concat(F.lit("blocked: "), get("$.promptFeedback.blockReason")), F.lit("no candidates"))
    proposed = F.when(get("$.candidates[0]").isNull(), told(none, blocked)).when(part.isNull(), told(none, F.concat(F.lit("no text, ended by "), ended))).when(readable(part), told(part, none)).otherwise(told(none, F.lit("the reply is no JSON")))

    blocks = F.from_json(get("$.content"), "array<struct<type: string, input: string>>")
    called = F.try_element_at(F.filter(blocks, lambda b: b["type"] == "tool_use"), F.lit(1))
    kinds = F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(F.transform(blocks, lambda b: b["type"]))), ", "), F.lit("")), F.lit("nothing"))
    listed = F.when(called.isNotNull(), told(F.coalesce(called["input"], F.lit("{}")), none)).otherwise(told(none, F.concat(F.lit("no call, ended by "), F.coalesce(get("$.stop_reason"), F.lit("unknown")), F.lit(", with "), kinds)))
    return F.when(get("$.choices").isNotNull(), chosen).when(get("$.candidates").isNotNull() | get("$.promptFeedback").isNotNull(), proposed).otherwise(listed)


def chosen_provider(stated: str, keys: dict[str, str]) -> str | None:
    """The provider that is asked: the stated one, else the first that has a key, in the given order; None if none has."""
    return stated if stated in keys else next((name for name, key in keys.items() if key.strip()), None)
