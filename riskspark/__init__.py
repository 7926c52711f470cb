"""riskspark: social-post risk scoring and reporting on Spark DataFrames.

Scores are screening signals for aggregate study, not diagnoses of people.
"""

__version__ = "0.1.0"
