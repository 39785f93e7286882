"""Spark-native analytics over corpora that are organised around a syllabus."""
