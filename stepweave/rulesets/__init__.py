"""Rule sets shipped with the library."""

from stepweave.rulesets.website import website_qc_rules, website_rules

__all__ = ["website_qc_rules", "website_rules"]
