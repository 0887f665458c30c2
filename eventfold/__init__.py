"""eventfold: event-lifecycle analytics on Spark.

Batch entry points (DataFrame in, DataFrame out):

* :func:`derive_once` / :func:`derive` - derived events of the lifecycle rules
* :func:`lifecycle_closure` - a log closed under all rules
* :func:`latest_state`, :func:`latest_by_key`, :func:`state_get` - state tables
* :func:`fold_history` - aggregate state folded from an item's history
* :func:`decide`, :func:`command_events`, :func:`stuck_rollback` - commands
* :func:`command_outcome`, :func:`command_timeout` - command results
* :func:`build_lifecycle` with :class:`LifecycleSpec` - the generic lifecycle

Streaming counterparts live in :mod:`eventfold.streaming`.
"""

from eventfold.operators.asof import attach_first_after, attach_last_before  # noqa: F401
from eventfold.operators.closure import lifecycle_closure  # noqa: F401
from eventfold.operators.decisions import command_events, decide, decide_as_of, stuck_rollback  # noqa: F401
from eventfold.operators.derive import derive, derive_once, session_mismatch_report  # noqa: F401
from eventfold.operators.fold import fold_history  # noqa: F401
from eventfold.operators.outcomes import (  # noqa: F401
    alerts, command_outcome, command_timeout, delete_relay, event_router, rollback_failed_alert,
)
from eventfold.operators.references import Lookup, delete_reference_check, enrich_reference  # noqa: F401
from eventfold.operators.state import (  # noqa: F401
    filter_type, latest_by_key, latest_state, snapshot_events, snapshot_table, state_all, state_get,
)
from eventfold.plans.lifecycle import LifecycleSpec, build_lifecycle, partial_update  # noqa: F401

__version__ = "0.1.0"
