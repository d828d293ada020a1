"""Every registered job, by area."""

from lisura.plans import (  # noqa: F401
    jobs_browse,
    jobs_detect,
    jobs_graph,
    jobs_normalize,
    jobs_stored,
    jobs_tables,
)
