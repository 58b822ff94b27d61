"""The query language: text to tokens, statement, plan and DataFrame."""

from lorebank.plans.mql.executor import Engine, execute, run
from lorebank.plans.mql.parser import MqlError, parse
from lorebank.plans.mql.planner import Plan, plan

__all__ = ["Engine", "MqlError", "Plan", "execute", "parse", "plan", "run"]
