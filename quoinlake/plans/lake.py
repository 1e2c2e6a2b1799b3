"""Where a deployment keeps its tables."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Lake:
    """Table paths under two roots that every executor can reach."""

    root: str
    models: str

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def raw(self) -> str:
        return self.table("listings_raw")

    @property
    def pool(self) -> str:
        return self.table("listings_pool")

    @property
    def newest(self) -> str:
        return self.table("listings_newest")

    @property
    def scored_input(self) -> str:
        return self.table("scored_input")

    @property
    def clean(self) -> str:
        return self.table("listings_clean/sale")

    @property
    def features(self) -> str:
        return self.table("listings_features/sale")

    @property
    def predictions(self) -> str:
        return self.table("predictions")

    @property
    def market(self) -> str:
        return self.table("macro_raw")

    @property
    def monthly(self) -> str:
        return self.table("macro_monthly")

    def stats(self, version: str) -> str:
        """Cleaning statistics, kept with the model that was trained on them."""
        return self.table(f"control/v{version}/impute_stats")

    def gate(self, version: str) -> str:
        return self.table(f"control/v{version}/gate")

    @property
    def metrics(self) -> str:
        return self.table("control/metrics")

    @property
    def promotions(self) -> str:
        return self.table("control/promotions")

    @property
    def drift_log(self) -> str:
        return self.table("control/drift_log")
