"""Messages of live sessions: JSON texts that carry sound as base64 or control the session, and plain sound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grammar import let

_MESSAGE = "type string, call_id string, model string, model_name string, audio struct<data:string,sample_rate:string>"
CONTROLS = ("start", "flush", "stop")


def parsed(text: Column, binary: Column | None = None) -> Column:
    """struct(kind, payload, rate, model, call_id) of one message.

    kind: start, flush, stop, audio, or null for what is neither (broken JSON and base64 too: they are ignored, as nothing
    else can be told from them). rate is null where the message names none: the session keeps the rate it had.
    """

    def fields(body: Column) -> Column:
        sound = F.try_to_binary(body["audio"]["data"], F.lit("base64"))
        sound = sound if binary is None else F.coalesce(binary, sound)
        rate = body["audio"]["sample_rate"]
        return F.struct(
            F.when(body["type"].isin(*CONTROLS), body["type"]).alias("control"), F.when(F.octet_length(sound) > 0, sound).alias("sound"), F.when(rate.rlike("^0*[1-9][0-9]{0,8}$"), rate.cast("int")).alias("rate"),
            F.coalesce(body["model"], body["model_name"]).alias("model"), body["call_id"].alias("call_id"),
        )

    kind = lambda m: F.coalesce(m["control"], F.when(m["sound"].isNotNull(), "audio"))
    return let(let(F.from_json(text, _MESSAGE), fields), lambda m: F.struct(kind(m).alias("kind"), m["sound"].alias("payload"), m["rate"].alias("rate"), m["model"].alias("model"), m["call_id"].alias("call_id")))
