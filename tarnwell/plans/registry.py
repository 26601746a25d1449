"""All registered plans: a query over a folder of tables, and the same in SQL."""

from __future__ import annotations

import tarnwell.plans.code  # noqa: F401  adds its plans
import tarnwell.plans.completing  # noqa: F401
import tarnwell.plans.diagnostics  # noqa: F401
import tarnwell.plans.rules  # noqa: F401
import tarnwell.plans.segments  # noqa: F401
import tarnwell.plans.typed  # noqa: F401
from tarnwell.plans.catalog import PORTABLE
from tarnwell.plans.frames import FRAMES, runner
from tarnwell.plans.oracles import OTHER
from tarnwell.plans.relations import oracle, portable

QUERIES = {name: portable(sql) for name, sql in PORTABLE.items()} | {name: runner(build) for name, (build, _) in FRAMES.items()}
ORACLES = {name: oracle(OTHER.get(name, sql)) for name, sql in PORTABLE.items()} | {name: oracle(OTHER.get(name, sql)) for name, (_, sql) in FRAMES.items() if sql}
