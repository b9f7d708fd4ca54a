"""A6 on answers that arrive in pieces: the two halves are told apart while text still comes in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundtable.operators.audit import BEYOND_MARK, CONTRAST, DEFLECTION, GROUNDED_MARK, OPENER_LENGTH
from groundtable.streaming.log_streams import LATE

SPLIT = "response_id long, seq long, part string, text string"
LAPSED = 1 << 62
_STATE = "held string, headed boolean, beyond boolean, opener string, opened boolean"
_UNSURE = re.compile(r"=[=A-Z+]*\Z")  # an end that more text may turn into a mark, or lengthen
_HEAD, _BEYOND, _GROUNDED = re.compile(GROUNDED_MARK), re.compile(BEYOND_MARK), re.compile(GROUNDED_MARK)
_SENTENCE = re.compile(r"\s*[^.!?]*[.!?]", re.ASCII)
_DEFLECTS, _TURNS = re.compile(DEFLECTION, re.I | re.ASCII), re.compile(CONTRAST, re.I | re.ASCII)
_SPACE = " \t\n\x0b\f\r"


class AnswerSplitter:
    """Takes an answer piece by piece and gives text out as soon as no later text can change where it belongs.

    What is held back is an end that could belong to a mark, the answer's start until it is known whether a
    mark leads it, and the grounded half's first sentence (at most 400 characters) until something follows.
    However the text is cut, what is given out in all is what ``split_beyond`` makes of the whole.
    """

    def __init__(self, held: str = "", headed: bool = False, beyond: bool = False, opener: str = "", opened: bool = False):
        self.held, self.headed, self.beyond, self.opener, self.opened = held, headed, beyond, opener, opened

    def state(self) -> tuple:
        return self.held, self.headed, self.beyond, self.opener, self.opened

    def push(self, text: str, last: bool = False) -> list[tuple[str, str]]:
        """(part, text) pieces that are now certain; ``last`` says that nothing more will come."""
        self.held += text
        if not self.headed and not self._head(last):
            return []
        out = []
        if not self.beyond:
            unsure = None if last else _UNSURE.search(self.held)
            sure = self.held[: unsure.start()] if unsure else self.held
            mark = _BEYOND.search(sure)
            grounded = sure[: mark.start()] if mark else sure
            self.held = self.held[mark.end() if mark else len(sure) :]
            self.beyond = mark is not None
            out.append(("grounded", self._open(_GROUNDED.sub("", grounded), last)))
        if self.beyond:
            out.append(("beyond", self.held))
            self.held = ""
        return [(part, piece) for part, piece in out if piece]

    def _head(self, last: bool) -> bool:
        """Take a leading mark away; false while it is not known whether there is one."""
        lead = self.held.lstrip(_SPACE)
        unsure = _UNSURE.match(lead)
        mark = _HEAD.match(lead)
        after = lead[mark.end() :] if mark else ""
        if not last and (not lead or unsure or mark and after in ("", "\r")):
            return False
        if mark:
            self.held = after[2:] if after.startswith("\r\n") else after.removeprefix("\n")
        self.headed = True
        return True

    def _open(self, text: str, last: bool) -> str:
        """The grounded text, its first sentence only once it can be judged."""
        if self.opened:
            return text
        self.opener += text
        sentence = _SENTENCE.match(self.opener)
        first = sentence.group() if sentence else ""
        rest = self.opener[len(first) :]
        judged = first != "" and len(first) <= OPENER_LENGTH and (rest.strip(_SPACE) != "" or self.beyond)
        if not (judged or last or self.beyond or len(self.opener) > OPENER_LENGTH and not 0 < len(first) <= OPENER_LENGTH):
            return ""
        out, self.opener, self.opened = self.opener, "", True
        if judged and _DEFLECTS.search(first.strip(_SPACE)) and not _TURNS.search(first):
            return rest.lstrip(_SPACE)
        return out


def split_stream(frames: DataFrame, wait_ms: int = 60_000) -> DataFrame:
    """(response_id, seq, part, text): answers split while they arrive, in pieces that follow one another.

    ``frames`` has response_id, seq, event, data and ts; ``token`` frames carry text, ``done`` ends a response,
    and so does event time ``wait_ms`` past its last frame.  Pieces bear the number of the frame that made
    them certain; the last ones after a lapse bear ``LAPSED``.  State is the text that is held back.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        splitter = AnswerSplitter(*state.get) if state.exists else AnswerSplitter()
        out: list[tuple] = []
        ended = state.hasTimedOut
        if ended:
            out += [(key[0], LAPSED, *piece) for piece in splitter.push("", True)]
        else:
            rows = pd.concat(list(parts)).sort_values("seq")
            for seq, event, data in zip(rows["seq"], rows["event"], rows["data"]):
                ended = ended or event == "done"
                out += [(key[0], seq, *piece) for piece in splitter.push((data or "") if event == "token" else "", event == "done")]
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update(splitter.state())
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + wait_ms)
        yield pd.DataFrame(out, columns=["response_id", "seq", "part", "text"])

    rows = frames.withWatermark("ts", LATE).select("response_id", F.col("seq").cast("long").alias("seq"), "event", "data", "ts")
    return rows.groupBy("response_id").applyInPandasWithState(step, SPLIT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
