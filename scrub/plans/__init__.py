"""Named queries over the test tables, each with its DuckDB oracle where SQL can express it."""

from scrub.plans import q_masking  # noqa: F401
from scrub.plans import q_detect  # noqa: F401
from scrub.plans import q_redact  # noqa: F401
from scrub.plans import q_tables  # noqa: F401
from scrub.plans import q_docs  # noqa: F401
from scrub.plans import q_audit  # noqa: F401
from scrub.plans import q_gazetteer  # noqa: F401
from scrub.plans import q_io  # noqa: F401
