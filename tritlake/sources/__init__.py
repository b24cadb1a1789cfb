"""Sources and sinks: image files, vectors as images, persisted models."""
