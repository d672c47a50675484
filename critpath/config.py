"""Settings of the graph construction."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """window: ticks of an epoch; threshold: gaps below it are closed; message_delay: longest delay of a message, later
    receives are moved (None: no limit); waiting_message: messages that took longer block (0: none); insert_waiting:
    whether gaps before a receive are Waiting; wide_operators: keep operator ids instead of their low byte; nested: the
    trace's source makes activities that nest, so the plan for overlaps isn't needed (default: every timeline is looked at)."""

    window: int
    threshold: int
    message_delay: int | None = None
    waiting_message: int = 0
    insert_waiting: bool = True
    wide_operators: bool = False
    strict: bool = False
    nested: bool = False
