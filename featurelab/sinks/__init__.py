"""Writers: datasets, manifests, evaluation reports, metric logs."""
