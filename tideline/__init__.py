"""tideline: regime analytics for keyed time series, written as DataFrame -> DataFrame functions."""
