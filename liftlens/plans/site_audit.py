"""The site audit end to end: facts, issues and their summaries of a before and an after crawl."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from liftlens.operators import audit as A
from liftlens.operators import report as R
from liftlens.operators.page_facts import page_facts
from liftlens.session import materialize


@dataclass
class SiteAudit:
    """Lazy audit tables. Parsing the pages is the costly step and several rules read its result, so the
    facts are stored once. The rules on statuses read a stored index without the page bodies."""

    crawl: DataFrame

    @cached_property
    def facts(self) -> DataFrame:
        return materialize(page_facts(self.crawl), "page_facts")

    @cached_property
    def index(self) -> DataFrame:
        return materialize(self.crawl.drop("html", "content_type"), "crawl_index")

    def issues(self) -> DataFrame:
        return A.site_issues(self.facts, self.index)

    @cached_property
    def summary(self) -> DataFrame:
        return R.audit_summary(self.issues())

    def category_totals(self) -> DataFrame:
        return R.category_totals(self.summary)
