"""Mixed variables generated, prepared, resampled, evaluated and reported: python -m loomframe <this file>."""

from loomframe.operators import mimic, report
from loomframe.plans.chain import Apply, Chain, Runner


def build(spark, settings):
    n = int(settings.conf.get("rows", 2000))
    names = {"unordered": ["d", "e"], "ordered": ["f", "g"], "continuous": ["a", "b", "c"]}

    def generated(_):
        return mimic.mixed_variables(spark, n, [{"mean": 1.0}, {"std": 3.0}, {}], [[0.2, 0.2, 0.3, 0.3], [0.6, 0.4]], [[0.2, 0.5, 0.3], [0.2] * 5], missing={"b": 20}, seed=settings.seed)

    def written(original, sample):
        found = mimic.evaluation(original.withColumnRenamed("id", "ID"), sample, [*names["unordered"], *names["ordered"]], names["continuous"])
        return report.write_report(report.mimic_pages(found, original, sample, names["continuous"]), settings.results, "mimic")

    return Runner([
        Chain("generate", [Apply(generated, "size", "df")]),
        Chain("prepare", [Apply(mimic.prepare, "df", "prepared", key="id", strings=["d", "e"], **names), Apply(mimic.kernel_bandwidths, "prepared", "widths")]),
        Chain("resample", [Apply(mimic.resample_prepared, ["prepared", "widths"], "df_resample", seed=settings.seed)]),
        Chain("report", [Apply(written, ["df", "df_resample"], "files")]),
    ])
