"""File sources: image folders and archives, array artifacts, manifests, statistics."""
