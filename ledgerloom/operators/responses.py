"""Raw model answers as columns: parsing, repair, bounds, the second attempt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import strip

ROUTER = "doc_type string, language string, reason string, confidence string, suggested_fields array<struct<name:string,description:string,likely_required:boolean>>"
EXTRACTOR = "fields array<struct<name:string,value:string,confidence:string,source_span:string,likely_required:boolean>>"
JUDGE = "score string, issues array<struct<field:string,message:string,severity:string>>, notes string"
LANGUAGES = ("en", "th", "other")


def unfenced(raw: Column) -> Column:
    """The text without code fences: the first line if it opens one, and every line that is one."""
    text = strip(raw)
    opened = F.regexp_replace(text, r"^```[^\n]*\n?", "")
    return F.when(text.startswith("```"), strip(F.regexp_replace(opened, r"(?m)^\s*```[^\n]*$\n?", ""))).otherwise(text)


def json_of(raw: Column) -> Column:
    """The JSON object in an answer: the whole text without fences, else from the first { to the last }."""
    whole = unfenced(raw)
    inner = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(whole).isNotNull() & whole.startswith("{"), whole).when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)


def bounded(text: Column) -> Column:
    """A share given as number, number text or boolean, null outside of 0 to 1."""
    number = F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0).otherwise(strip(text).try_cast("double"))
    return F.when(number.between(0, 1), number)


def router_response(raw: Column) -> Column:
    """The parsed router answer, null as a whole if the language or the confidence is out of bounds."""
    parsed = F.from_json(json_of(raw), ROUTER)
    good = parsed["doc_type"].isNotNull() & parsed["language"].isin(*LANGUAGES) & bounded(parsed["confidence"]).isNotNull()
    return F.when(good, parsed)


def extractor_response(raw: Column) -> Column:
    """The parsed extractor answer, null as a whole if any confidence is out of bounds or any name missing."""
    parsed = F.from_json(json_of(raw), EXTRACTOR)
    good = parsed["fields"].isNotNull() & F.forall(parsed["fields"], lambda f: f["name"].isNotNull() & bounded(f["confidence"]).isNotNull())
    return F.when(good, parsed)


def judge_response(raw: Column) -> Column:
    parsed = F.from_json(json_of(raw), JUDGE)
    return F.when(bounded(parsed["score"]).isNotNull(), parsed)


def two_attempts(raw_1: Column, raw_2: Column, parse) -> Column:
    """A struct of the answer of the first attempt that parses, the attempt used and the error."""
    first, second = parse(raw_1), parse(raw_2)
    answer = F.coalesce(first, second)
    attempt = F.when(first.isNotNull(), 1).otherwise(2)
    return F.struct(answer.alias("answer"), attempt.alias("attempt"), F.when(answer.isNull(), "unparsable").alias("error"))


def attempted_call(raw_1: Column, failed_1: Column, tokens_1: Column, raw_2: Column, failed_2: Column, tokens_2: Column, parse) -> Column:
    """A struct of the answer, the attempt used, the error and the tokens of the last attempt made.

    `failed_1` and `failed_2` are the messages of failed transports, null where the call came through. A first call
    that failed is as good as one that doesn't parse; a second one that failed is the error. The repair call carries
    text only, also where the first one carried an image, so pages of images need no other operator.
    """
    first, second = F.when(failed_1.isNull(), parse(raw_1)), F.when(failed_2.isNull(), parse(raw_2))
    done = first.isNotNull()
    error = F.when(done | second.isNotNull(), None).otherwise(F.coalesce(failed_2, F.lit("unparsable")))
    return F.struct(F.coalesce(first, second).alias("answer"), F.when(done, 1).otherwise(2).alias("attempt"), error.alias("error"), F.when(done, tokens_1).otherwise(F.coalesce(tokens_2, tokens_1)).alias("tokens"))
