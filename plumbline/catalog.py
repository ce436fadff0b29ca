"""Importing this module registers every query."""

from plumbline.plans import collapse, designs, fixes, localize, planning, profile, quality, scorecard, service, signatures, streams  # noqa: F401


def flagship(spark, sf_dir):
    return scorecard.line_item_scorecard(spark, sf_dir)
