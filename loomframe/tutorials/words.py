"""Counts the words of a file that comes with the package: python -m loomframe <this file>."""

from loomframe.plans.chain import Chain, Print, Read, Runner, WordCount
from loomframe.sources import io


def build(spark, settings):
    path = settings.conf.get("path", f"file://{io.fixture('words.txt')}")
    return Runner([Chain("read", [Read(spark, path, "lines")]), Chain("count", [WordCount("lines", "words"), Print(["words"])])])
