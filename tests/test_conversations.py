"""Conversations as state of a stream, over a restart and a timeout."""

import sys
import time

from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusquery.operators import prompts
from corpusquery.streaming import conversations

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Echo:
    """Answers with the number of messages in the prompt, and has no reply to one question."""

    def complete(self, asked):
        return [None if p.endswith("mute") else f"{p.count('user: ')} before" for p in asked]


def run(spark, folder, **options):
    schema = "session string, turn bigint, text string"
    stream = conversations.answered(spark.readStream.schema(schema).parquet(str(folder / "in")), Echo, "Be brief.", **options)
    query = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(once=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return {(r.session, r.turn): r for r in spark.read.schema(conversations.OUTPUT).parquet(str(folder / "out")).collect()}


def put(spark, folder, *rows):
    (folder / "in").mkdir(exist_ok=True)
    spark.createDataFrame(list(rows), "session string, turn bigint, text string").coalesce(1).write.mode("append").parquet(str(folder / "in"))


def test_a_conversation_goes_on_after_a_restart(spark, tmp_path):
    put(spark, tmp_path, ("a", 1, "second"), ("a", 0, "first"), ("b", 0, "mute"), ("b", 1, None))
    got = run(spark, tmp_path, messages=4)
    assert got["a", 0].prompt == "Be brief.\n\nfirst" and got["a", 0].answer == "0 before"
    assert got["a", 1].prompt == "Be brief.\n\nuser: first\n\nassistant: 0 before\n\nsecond" and got["a", 1].answer == "1 before"
    assert got["b", 0].answer == "" and got["b", 1].prompt == "Be brief.\n\nuser: mute\n\nassistant: \n\n"
    put(spark, tmp_path, ("a", 2, "third"), ("a", 3, "fourth"), ("c", 0, "new"))
    got = run(spark, tmp_path, messages=4)
    assert len(got) == 7 and got["a", 2].prompt == "Be brief.\n\nuser: first\n\nassistant: 0 before\n\nuser: second\n\nassistant: 1 before\n\nthird"
    # only the latest messages
    assert got["a", 3].prompt == "Be brief.\n\nuser: second\n\nassistant: 1 before\n\nuser: third\n\nassistant: 2 before\n\nfourth"
    assert got["c", 0].prompt == "Be brief.\n\nnew"
    # as columns make it
    history = F.array(F.struct(F.lit("user").alias("role"), F.lit("first").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("0 before").alias("content")))
    assert spark.range(1).select(prompts.flattened_chat(F.lit("second"), history, F.lit("Be brief."))).first()[0] == got["a", 1].prompt


def test_an_idle_session_is_forgotten(spark, tmp_path):
    put(spark, tmp_path, ("a", 0, "first"))
    run(spark, tmp_path, idle=1)
    time.sleep(0.1)
    put(spark, tmp_path, ("b", 0, "other"))
    run(spark, tmp_path, idle=1)
    put(spark, tmp_path, ("a", 1, "again"))
    assert run(spark, tmp_path, idle=1)["a", 1].prompt == "Be brief.\n\nagain"
