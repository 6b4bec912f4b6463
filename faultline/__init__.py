"""faultline: bug-localisation analytics as Spark DataFrame jobs.

Every public operator is a function ``DataFrame(s) -> DataFrame`` with no
action inside; compositions live in :mod:`faultline.plans`.
"""

__version__ = "0.1.0"
