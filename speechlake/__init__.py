"""Spark jobs for speech-audio data."""
