"""Conversations as state of a stream: questions come in, each is answered with the turns before it in the prompt."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import providers

OUTPUT = "session string, turn bigint, question string, prompt string, answer string"
#: Messages of a session that a prompt holds at most, the latest; milliseconds without a question after which a session is forgotten.
MESSAGES, IDLE = 40, 3_600_000


def flattened(system: str, history: list[list[str]], question: str) -> str:
    """System text (if any), then ``role: content`` of each message, then the question: what ``prompts.flattened_chat`` makes of columns."""
    return "\n\n".join([*([system] if system else []), *(f"{role}: {content}" for role, content in history), question])


def answered(questions: DataFrame, model: Callable, system: str = "", messages: int = MESSAGES, idle: int = IDLE) -> DataFrame:
    """A stream of questions(session, turn, text) -> session, turn, question, prompt, answer, each question once.

    A session's state is its latest messages; it is kept in Spark's state store, so that a query that starts again from its
    checkpoint goes on with the conversations as they were, and is dropped when no question has come for ``idle`` milliseconds.
    Questions of one batch are answered in the order of their turns, each with the answers before it; a null text is an empty
    question, and a call that fails is an empty answer. Questions without a session are one session."""
    made = providers.maker(model)

    def talk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        history = json.loads(state.get[0]) if state.exists else []
        asked, out = pd.concat(list(batches)).sort_values(["turn", "text"], kind="stable"), []
        for turn, text in zip(asked["turn"], asked["text"], strict=True):
            question = text or ""
            prompt = flattened(system, history, question)
            answer = (made().complete([prompt])[0] or "").strip()
            history = [*history, ["user", question], ["assistant", answer]][-messages:]
            out.append((key[0], turn, question, prompt, answer))
        state.update((json.dumps(history),))
        state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["session", "turn", "question", "prompt", "answer"])

    rows = questions.selectExpr("cast(session AS string) AS session", "cast(turn AS bigint) AS turn", "text")
    return rows.groupBy("session").applyInPandasWithState(talk, OUTPUT, "history string", "append", GroupStateTimeout.ProcessingTimeTimeout)
