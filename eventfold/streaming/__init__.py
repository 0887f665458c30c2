"""Structured Streaming forms: the keyed-state as-of processor (``asof_state``),
command outcome and timeout with event-time timers (``outcomes_state``), and the
streaming jobs and sinks, including the closure loop (``jobs``)."""
