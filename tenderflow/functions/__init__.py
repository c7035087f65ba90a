from tenderflow.functions.predicates import *  # noqa: F401,F403
from tenderflow.functions.scalars import *  # noqa: F401,F403
