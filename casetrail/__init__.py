"""casetrail: evidence-collection analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames; nothing is collected to
the driver and "now" is always an explicit ``as_of`` argument.
"""

from casetrail.session import build_session, tune

__all__ = ["build_session", "tune"]
