"""Sources and sinks: delimited text, .npy and .npz, raw buffers; Parquet is the native form."""
