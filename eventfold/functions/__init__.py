"""Pure Column expressions, identical for batch and streaming frames."""

from eventfold.functions.predicates import (  # noqa: F401
    author_differs, change_granted, clone_visible, deletable, is_locked, same_session,
    within_timeout,
)
from eventfold.functions.selection import sel_clear, sel_remove, sel_union  # noqa: F401
from eventfold.functions.settings import (  # noqa: F401
    map_new_selection, set_fields_accessed, set_fields_clone, set_fields_save, version_next,
)
